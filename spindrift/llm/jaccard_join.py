"""N-gram Jaccard self-join with prefix filters under two global token orders.

A document's set holds its distinct n-word shingles. Under any total order of shingles, two sets
with Jaccard similarity >= t share a shingle among the first |A| - ceil(t|A|) + 1 of each. This
holds for every order at once, so a candidate pair has to share a prefix shingle under each of three
orders before it is verified. Each order puts rare shingles first, by an independent fixed-size
count sketch (2**18 counters; a bounded broadcast). The sketch only chooses the order, any of which
is right, so its collisions cost time and never a link.

Plan
1. One scan: set size and 128-bit digest of each document, and the three sketches. Documents with
   equal sets form a class (partial aggregation: a hot group of copies is one row for each task).
2. One scan: prefix shingles of all orders, copies reduced to one within a task. Shingles of one
   class alone fall away, or of classes whose sizes are too far apart, then classes that are left
   without a shared prefix shingle in any of the orders.
3. Stars: in each shingle's group the class that has the fewest rarer shingles is the pivot; pivot
   and member are verified on whole texts (only those texts are fetched, by way of a bitmap sized by
   their number). Linear in the group, so families of near copies fall into one component without
   all their pairs.
4. Rest: pairs of a group (groups of up to 16 classes with no pair besides the pivot's that passes the
   filters are left out) that are still in different components and pass the filters by length,
   position, second order and parity bitmap (Sandes et al. 2020: the bitmaps of two sets differ in at
   most |A xor B| bits) are verified too. No link between components is lost, and no cap is used.
   Within a group the second order is checked by a signature; of the pairs that are left, the whole
   lists of shared prefix shingles of the second and third order are intersected, and whole bitmaps
   compared, before any text is fetched.
5. Components of all links by star contraction; every document gets its class's component.

Hot shingles and classes. A shingle whose counter has more than an eighth of a partition's share is
dealt by shingle and class, each part has its own pivot, and the pivots of all parts meet in a
second star step. In step 4 the members of such a shingle that have its commonest label are dealt
out, and the others go to each part. The texts of a class that is in many pairs are repeated, 16
times the number of partitions at most in all, and its pairs dealt out. A class of very many
documents is joined back by way of a broadcast of at most 8 rows a partition.

Set sizes and verification work on 64-bit shingle hashes made of 64-bit word hashes.

Defined cases: null or empty text, or text of white space: set size 0, linked with nothing. Null
doc_id: its size is given, component_id is null, it links nothing. A doc_id that occurs more than
once is one document with several texts: it links by any of them, and each row is returned. Empty
table: no rows. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import _text as tx
from spindrift.operators.graph import components

U64, I64 = np.uint64, np.int64
SKETCH_BITS = 18
BITMAP = 512
_SLICES = 8  # of a sketch, on its way
_LOW = U64((1 << (64 - SKETCH_BITS)) - 1)
_SECOND = U64(0xA0761D6478BD642F)
_ORDERS = (U64(0), _SECOND, U64(0xE7037ED1A0B428DB))
_CLASS = 9  # in the place of an order: a class's bitmap


def _sets(raw: np.ndarray, off: np.ndarray, n: int):
    """(shingle hashes with repeats, ends): those of text i stand before ends[i]."""
    start, end, doc = tx.words(raw, off)
    doc, value = tx.shingles(tx.word_hashes(raw, start, end), doc, len(off) - 1, n)
    return value, np.searchsorted(doc, np.arange(len(off) - 1), "right")


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _digest(x: np.ndarray) -> tuple[int, int]:
    a = tx.mix(x ^ _SECOND)
    with np.errstate(over="ignore"):
        return int((np.bitwise_xor.reduce(tx.mix(x)) + a.sum(dtype=U64)).astype(I64)), int((tx.mix(a) * (x | U64(1))).sum(dtype=U64).astype(I64))


def _profile(n: int):
    """Scan 1: doc_id, size, digest for each text, and at the end of a task its sketches."""

    def run(batches):
        counts = np.zeros((len(_ORDERS), 1 << SKETCH_BITS), np.uint32)
        for rows, raw, off in tx.pieces(batches):
            value, ends = _sets(raw, off, n)
            shift = U64(64 - SKETCH_BITS)
            for k in range(len(_ORDERS)):
                x = _ordered(value, k)
                counts[k] += np.bincount((x >> shift).astype(I64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            size, d1, d2 = [], [], []
            at = 0
            for e in ends.tolist():
                own = _unique(value[at:e])
                at = e
                a, b = _digest(own) if len(own) else (0, 0)
                size.append(len(own))
                d1.append(a)
                d2.append(b)
            m = len(size)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "n", "d1", "d2", "bucket", "counts"])
        if counts.any():
            n_slices = _SLICES * len(_ORDERS)
            parts = counts.reshape(n_slices, -1)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n_slices, pa.int64())] * 4, pa.array(range(n_slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["doc_id", "n", "d1", "d2", "bucket", "counts"])

    return run


def _add(slices: int, kind):
    """Sums sketches of a kind of number slice by slice."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(part.as_buffer(), kind).astype(I64)
                total[k % slices] = total[k % slices] + x if k % slices in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["bucket", "counts"])

    return run


def _ranks(sketch: DataFrame, parts: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each order, the place of each counter when they are sorted by count, and by place the number of parts that its shingles are dealt to. Their size doesn't depend on the input. The sketches of many tasks are added up in two steps."""
    slices, row, kind = _SLICES * len(_ORDERS), "bucket int, counts binary", np.uint32
    groups = -(-sketch.count() // (64 * slices))  # a row for each task and slice
    if groups > 1:
        spread = sketch.select((F.col("bucket") + slices * F.pmod(F.xxhash64("counts"), F.lit(groups))).cast("int").alias("bucket"), "counts")
        sketch, kind = tx.deal(spread, slices * groups).mapInArrow(_add(slices, kind), row), I64
    found = {r["bucket"]: np.frombuffer(bytes(r["counts"]), I64) for r in tx.deal(sketch, slices).mapInArrow(_add(slices, kind), row).collect()}
    width = (1 << SKETCH_BITS) // _SLICES
    counts = np.concatenate([found.get(k, np.zeros(width, I64)) for k in range(slices)]).reshape(len(_ORDERS), -1)
    order = np.argsort(counts, axis=1, kind="stable")
    prefixes = np.maximum(1, counts.sum(1, keepdims=True) * (den - num) // den)
    salts = np.maximum(1, -(-np.take_along_axis(counts, order, 1) * 8 * parts // prefixes))
    return np.argsort(order, axis=1).astype(np.uint32), salts.astype(np.uint32)


def _ordered(value: np.ndarray, k: int) -> np.ndarray:
    """The shingles' hashes for an order."""
    return tx.mix(value ^ _ORDERS[k]) if k else value


def _home(token: np.ndarray, cls: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """What a record is dealt by: its shingle, and for hot ones a part by class."""
    return tx.mix(token + (tx.mix(cls.view(U64) ^ _SECOND) % salts.astype(U64)) * U64(0xD6E8FEB86659FD93))


def _salts(token: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return salts[(token >> U64(64 - SKETCH_BITS)).astype(I64)]


def _token(value: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingle's place in the order, a bijection of its hash: counter's rank, then the hash's other bits."""
    return (ranks[(value >> U64(64 - SKETCH_BITS)).astype(I64)].astype(U64) << U64(64 - SKETCH_BITS)) | (value & _LOW)


def _prefixes(n: int, num: int, den: int, ranks, parts: int):
    """Scan 2: blocks of prefix shingles by shingle, for all orders."""
    names = ("token", "cls", "pos", "size")

    def run(batches):
        held: list[tuple] = []
        known: dict[int, bytes] = {}
        count = 0

        def flush():
            if known:  # one bitmap for each class, on its way to the class's own partition
                cls = np.fromiter(known, I64, len(known))
                empty = pa.array([b""] * len(cls), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tx.bucket_of(tx.mix(cls.view(U64)), parts)), pa.array(list(known.values()), pa.binary()), pa.array([c.tobytes() for c in cls], pa.binary()), empty, empty, pa.array(np.full(len(cls), _CLASS, np.int32))],
                    ["bucket", *names, "ord"],
                )
            for k in range(len(_ORDERS)):
                own = [h for h in held if h[0] == k]
                if own:
                    cols = dict(zip(names, (np.concatenate([h[i] for h in own]) for i in range(1, 5))))
                    home = tx.bucket_of(_home(cols["token"], cols["cls"], _salts(cols["token"], ranks.value[1][k])), parts)
                    for b in tx.blocks(home, _sent(cols, k)):
                        yield b.append_column("ord", pa.array(np.full(b.num_rows, k, np.int32)))
            held.clear()
            known.clear()

        for _, raw, off in tx.pieces(batches):
            value, ends = _sets(raw, off, n)
            at = 0
            order = ranks.value[0]
            for e in ends.tolist():
                own = _unique(value[at:e])
                at = e
                m = len(own)
                if not m or den * m < num * (m + 1):  # no other set can come near enough
                    continue
                cls = _digest(own)[0]
                if cls in known:
                    continue
                known[cls] = _bitmap(own)
                p = m - -(-num * m // den) + 1
                for k in range(len(_ORDERS)):
                    t = _token(_ordered(own, k), order[k])
                    t = np.sort(np.partition(t, p - 1)[:p]) if p < m else np.sort(t)
                    held.append((k, t, np.full(p, cls, I64), np.arange(p, dtype=np.uint32), np.full(p, m, np.uint32)))
                count += len(_ORDERS) * p
            if count > tx.FLUSH_RECORDS:
                yield from flush()
                count = 0
        yield from flush()

    return run


def _bitmap(x: np.ndarray) -> bytes:
    """The set's parity bitmap: bit k tells whether an odd number of shingles falls on k. Bitmaps of one length differ in at most |A xor B| bits."""
    bits = max(BITMAP, 1 << (len(x) // 2).bit_length())
    return np.packbits((np.bincount((tx.mix(x ^ _SECOND) & U64(bits - 1)).astype(I64), minlength=bits) & 1).astype(bool)).tobytes()


def _fold(bits: bytes, size: int) -> np.ndarray:
    """The bitmap that the same set has at ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


_REC = {"token": (U64, ()), "cls": (I64, ()), "pos": (np.uint32, ()), "size": (np.uint32, ())}
_SHORT = {"token": (np.uint8, (6,)), "cls": (I64, ()), "size": (np.uint32, ())}


def _sent(r: dict, k: int) -> dict:
    """A record's columns on their way. Of the orders after the first only 48 bits of the shingle, class and size are needed: two shingles taken for one let a pair through, never keep one out."""
    if not k:
        return r
    nothing = np.zeros((len(r["cls"]), 0), np.uint8)
    return {"token": np.ascontiguousarray(r["token"].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:], "cls": r["cls"], "pos": nothing, "size": r["size"]}


def _received(batches, k: int) -> dict:
    if not k:
        return tx.unpack(batches, _REC)
    r = tx.unpack(batches, _SHORT)
    wide = np.zeros((len(r["cls"]), 8), np.uint8)
    wide[:, 2:] = r["token"]
    return {"token": wide.view("<u8").reshape(-1).astype(U64), "cls": r["cls"], "size": r["size"]}


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of a sorted array."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(x))


def _by_order(batches) -> tuple[dict[int, list], list]:
    by: dict[int, list] = {k: [] for k in (*range(len(_ORDERS)), _CLASS)}
    for batch in batches:
        orders = batch.column(batch.schema.get_field_index("ord")).to_numpy()
        for k, own in by.items():
            if (orders == k).any():
                own.append(batch.filter(pa.array(orders == k)))
    return by, by.pop(_CLASS)


def _shared(num: int, den: int, parts: int, ranks):
    """Records of shingles that a class has together with one of a size that allows the similarity, by class; hot ones, which lie on several partitions, are taken to have such."""

    def run(batches):
        by, bitmaps = _by_order(batches)
        yield from bitmaps
        for k, own in by.items():
            r = _received(own, k)
            if not len(r["token"]):
                continue
            order = np.lexsort((r["cls"], r["size"], r["token"]))
            r = {c: v[order] for c, v in r.items()}
            keep = np.concatenate([[True], (r["token"][1:] != r["token"][:-1]) | (r["cls"][1:] != r["cls"][:-1])])
            r = {c: v[keep] for c, v in r.items()}
            size = r["size"].astype(I64)
            near = (r["token"][1:] == r["token"][:-1]) & (den * size[:-1] >= num * size[1:])  # neighbours by size are the nearest
            live = np.concatenate([near, [False]]) | np.concatenate([[False], near]) | (_salts(r["token"], ranks.value[1][k]) > 1)
            r = {c: v[live] for c, v in r.items()}
            for b in tx.blocks(tx.bucket_of(tx.mix(r["cls"].view(U64)), parts), _sent(r, k)):
                yield b.append_column("ord", pa.array(np.full(b.num_rows, k, np.int32)))

    return run


def _both(batches):
    """A row for each class that shares prefix shingles under all orders: those of the first with their places, a 256-bit signature of the second's, and the sorted lists of the second's and third's."""
    by, bitmaps = _by_order(batches)
    one, *others = (_received(by[k], k) for k in range(len(_ORDERS)))
    cls = np.unique(one["cls"])
    for r in others:
        cls = np.intersect1d(cls, r["cls"])
    if not len(cls):
        return
    lists = []
    for r in others:
        keep = np.isin(r["cls"], cls)
        c, t = r["cls"][keep], r["token"][keep]
        order = np.lexsort((t, c))
        c, t = c[order], t[order]
        start, end = _groups(c)
        lists.append((start, end, t))
    start, end, token = lists[0]
    sig = np.zeros((len(cls), 4), U64)
    bits = tx.mix(token) >> U64(56)
    np.bitwise_or.at(sig, (np.repeat(np.arange(len(cls)), end - start), (bits >> U64(6)).astype(I64)), U64(1) << (bits & U64(63)))
    sig = sig.view(I64)
    order = np.lexsort((one["pos"], one["cls"]))
    order = order[np.isin(one["cls"][order], cls)]
    one = {c: v[order] for c, v in one.items()}
    first, last = _groups(one["cls"])
    big = {int.from_bytes(c, "little", signed=True): b for m in bitmaps for c, b in zip(m.column(m.schema.get_field_index("cls")).to_pylist(), m.column(m.schema.get_field_index("token")).to_pylist())}
    big = [big[c] for c in cls.tolist()]
    rows = [[t[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())] for start, end, t in lists]
    step = 5000
    for at in range(0, len(cls), step):
        to = min(len(cls), at + step)
        a, b = first[at], last[to - 1]
        offsets = pa.array(np.append(first[at:to], b).astype(I64) - a, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[at:to]), pa.array(one["size"][first[at:to]].astype(I64)), *[pa.array(sig[at:to, i].copy()) for i in range(4)], pa.ListArray.from_arrays(offsets, pa.array(one["token"][a:b].view(I64))), pa.ListArray.from_arrays(offsets, pa.array(one["pos"][a:b].astype(np.int32))),
             pa.array([_fold(x, BITMAP // 8).tobytes() for x in big[at:to]], pa.binary()), pa.array(big[at:to], pa.binary()), *[pa.array(x[at:to], pa.binary()) for x in rows]],
            ["cls", "size", "s0", "s1", "s2", "s3", "tokens", "pos", "bits", "big", "second", "third"],
        )


_INC = "cls long, size long, s0 long, s1 long, s2 long, s3 long, tokens array<long>, pos array<int>, bits binary, big binary, second binary, third binary"
_WIDE = {**_REC, "part": (np.uint32, ()), "sig": (U64, (4,)), "bits": (U64, (BITMAP // 64,)), "label": (I64, ())}


class _Hot:
    """Shingles with over an eighth of a partition's share of the records: their parts and commonest labels; at most 8 * parts of them."""

    def __init__(self, token: np.ndarray, salts: np.ndarray, label: np.ndarray):
        order = np.argsort(token)
        self.token, self.salts, self.label = token[order], salts[order], label[order]

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, commonest label) of each shingle; one part for others."""
        if not len(self.token):
            return np.ones(len(token), I64), np.zeros(len(token), I64)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        hit = self.token[at] == token
        return np.where(hit, self.salts[at], 1), np.where(hit, self.label[at], 0)


def _hot(labelled: DataFrame, ranks, parts: int, records: int) -> _Hot:
    """Counts only shingles of hot counters."""

    def some(batches):
        for batch in batches:
            tokens = batch.column(0)
            token = tokens.flatten().to_numpy().view(U64)
            label = np.repeat(batch.column(1).to_numpy(), np.diff(tokens.offsets.to_numpy()))
            keep = _salts(token, ranks.value[1][0]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(I64)), pa.array(label[keep])], ["token", "label"])

    each = labelled.select("tokens", "label").mapInArrow(some, "token long, label long").groupBy("token", "label").agg(F.count("*").alias("n"))
    found = each.groupBy("token").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("label")).where(F.col("n") >= max(2, records // (8 * parts))).collect()
    n = np.array([r["n"] for r in found], I64)
    return _Hot(np.array([r["token"] for r in found], I64).view(U64), np.maximum(1, -(-n * 8 * parts // max(1, records))), np.array([r["label"] for r in found], I64))


def _part(cls: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (tx.mix(cls.view(U64) ^ _SECOND) % salts.astype(U64)).astype(I64)


def _deal_by(token: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    return tx.bucket_of(tx.mix(token + part.astype(U64) * U64(0xD6E8FEB86659FD93)), parts)


def _by_token(parts: int, hot, everywhere: bool):
    """Blocks by shingle again, now with signature and label. everywhere: records of a hot shingle without its commonest label go to all of its parts."""

    def run(batches):
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            lists = col["tokens"]
            count = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy().view(U64)
            row = np.repeat(np.arange(batch.num_rows), count)
            pos = col["pos"].flatten().to_numpy()
            cls, label = (col[c].to_numpy().astype(I64) for c in ("cls", "label"))
            salts, common = hot.value.find(token)
            part = _part(cls[row], salts)
            if everywhere and (salts > 1).any():
                copies = np.where((salts > 1) & (label[row] != common), salts, 1)
                at = np.repeat(np.arange(len(token)), copies)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                part = np.where(copies[at] > 1, nth, part[at])
                token, row, pos = token[at], row[at], pos[at]
            out = {"token": token, "cls": cls[row], "pos": pos.astype(np.uint32), "size": col["size"].to_numpy().astype(np.uint32)[row], "part": part.astype(np.uint32)}
            out["sig"] = np.stack([col[f"s{i}"].to_numpy().view(U64)[row] for i in range(4)], 1)
            out["bits"] = np.frombuffer(tx.utf8(col["bits"])[0].tobytes(), U64).reshape(-1, BITMAP // 64)[row]
            out["label"] = label[row] if everywhere else np.zeros((len(row), 0), np.uint8)
            yield from tx.blocks(_deal_by(token, part, parts), out)

    return run


def _possible(r: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of one shingle's group pass the filters by length, position, second order and bitmap."""
    a, b = r["size"][i].astype(I64), r["size"][j].astype(I64)
    pa_, pb = r["pos"][i].astype(I64), r["pos"][j].astype(I64)
    need = -(-num * (a + b) // (num + den))
    most = np.minimum(pa_, pb) + np.minimum(a - pa_, b - pb)
    keep = np.flatnonzero((need <= np.minimum(np.minimum(a, b), most)) & ((r["sig"][i] & r["sig"][j]) != 0).any(-1))
    apart = np.bitwise_count(r["bits"][i[keep]] ^ r["bits"][j[keep]]).sum(-1, dtype=I64)
    out = np.zeros(len(i), bool)
    out[keep[apart <= (a + b - 2 * need)[keep]]] = True
    return out


def _pairs(a: np.ndarray, b: np.ndarray):
    if len(a):
        x = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])


_WIDE_ROW = "bucket int, token binary, cls binary, pos binary, size binary, part binary, sig binary, bits binary, label binary"


def _sorted_records(batches, by_part: bool = True, label: bool = True) -> dict:
    r = tx.unpack(batches, {k: v for k, v in _WIDE.items() if label or k != "label"})
    order = np.lexsort((r["cls"], r["pos"], *([r["part"]] if by_part else []), r["token"]))
    return {c: v[order] for c, v in r.items()}


_PAIR, _OPEN, _PIVOT = 0, 1, 2  # kinds of rows that _stars returns
_STAR_ROW = "kind int, a long, b long, place int, " + _WIDE_ROW
_SMALL = 16
FEW = 100_000  # ids that are broadcast as they are


def _stars(num: int, den: int, parts: int, hot):
    """(a, b): pivot and member of each part of a shingle's group. For groups with other pairs that pass the filters, too large to look through, or in parts: (class, shingle, place) of each record. And the records of the pivots of hot shingles, by shingle. hot None: parts are one, and pairs alone are returned."""
    names = [x.split()[0] for x in _STAR_ROW.split(", ")]

    def rows(kind, a, b, place, wide=None):
        n = len(a)
        rest = wide.columns if wide else [pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * (len(names) - 5)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), a, b, place, *rest], names)

    def run(batches):
        r = _sorted_records(batches, hot is not None, False)
        if not len(r["token"]):
            return
        new = r["token"][1:] != r["token"][:-1]
        if hot is not None:
            new |= r["part"][1:] != r["part"][:-1]
        start = np.concatenate([[0], np.flatnonzero(new) + 1])
        end = np.append(start[1:], len(r["token"]))
        if hot is not None:
            divided = hot.value.find(r["token"][start])[0] > 1
            again = start[divided]
            out = {c: v[again] for c, v in r.items()} | {"label": np.zeros((len(again), 0), np.uint8)}
            for b in tx.blocks(tx.bucket_of(tx.mix(r["token"][again]), parts), out):
                none = pa.nulls(b.num_rows, pa.int64())
                yield rows(_PIVOT, none, none, pa.nulls(b.num_rows, pa.int32()), b)
            open_ = np.flatnonzero(divided | more(r, start, end))
            if len(open_):
                n = (end - start)[open_]
                at = np.repeat(start[open_], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield rows(_OPEN, pa.array(r["cls"][at]), pa.array(r["token"][at].view(I64)), pa.array(r["pos"][at].astype(np.int32)))
        pivot = np.repeat(start, end - start)
        member = np.arange(len(pivot))
        keep = member != pivot
        pivot, member = pivot[keep], member[keep]
        keep = _possible(r, pivot, member, num, den)
        for b in _pairs(r["cls"][pivot[keep]], r["cls"][member[keep]]):
            yield rows(_PAIR, *b.columns, pa.nulls(b.num_rows, pa.int32()))

    def more(r, start, end):
        """Whether a group may have pairs besides its pivot's."""
        size = end - start
        out = size > _SMALL
        for n in range(3, _SMALL + 1):
            groups = np.flatnonzero(size == n)
            i, j = np.triu_indices(n - 1, 1)
            step = max(1, 200_000 // len(i))
            for at in range(0, len(groups), step):
                first = start[groups[at : at + step]][:, None] + 1
                found = _possible(r, (first + i).reshape(-1), (first + j).reshape(-1), num, den)
                out[groups[at : at + step]] = found.reshape(-1, len(i)).any(1)
        return out

    return run


def _across(num: int, den: int, hot):
    """Pairs of each group whose labels differ, looked for among the records that _stars left open: everyone outside the group's largest label against everyone with another label. Two records that go to all parts of a hot shingle meet in one of them."""

    def run(batches):
        r = _sorted_records(batches)
        if not len(r["token"]):
            return
        start = np.concatenate([[0], np.flatnonzero((r["token"][1:] != r["token"][:-1]) | (r["part"][1:] != r["part"][:-1])) + 1])
        end = np.append(start[1:], len(r["token"]))
        label = r["label"]
        mixed = np.maximum.reduceat(label, start) != np.minimum.reduceat(label, start)
        salts, common = hot.value.find(r["token"][start])
        out_a, out_b, held = [], [], 0
        for s, e, n_parts, most in zip(start[mixed].tolist(), end[mixed].tolist(), salts[mixed].tolist(), common[mixed].tolist()):
            own = label[s:e]
            names, number = np.unique(own, return_inverse=True)
            rest = np.flatnonzero(number != np.bincount(number).argmax())
            is_rest = np.zeros(e - s, bool)
            is_rest[rest] = True
            everywhere = own != most
            elsewhere = _part(r["cls"][s:e], np.full(e - s, n_parts)) != r["part"][s]
            for at in range(0, len(rest), max(1, 100_000 // (e - s))):
                u = rest[at : at + max(1, 100_000 // (e - s))]
                ok = (number[u][:, None] != number[None, :]) & (~is_rest[None, :] | (np.arange(e - s)[None, :] > u[:, None]))
                if n_parts > 1:
                    ok &= ~((everywhere[u] & elsewhere[u])[:, None] & everywhere[None, :])
                i, j = np.nonzero(ok)
                i, j = u[i] + s, j + s
                keep = _possible(r, i, j, num, den)
                out_a.append(r["cls"][i[keep]])
                out_b.append(r["cls"][j[keep]])
                held += int(keep.sum())
            if held > 500_000:
                yield from _pairs(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, held = [], [], 0
        if out_a:
            yield from _pairs(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted lists share a value."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return bool((x[at] == y).any())


def _near(num: int, den: int):
    """The pairs that share prefix shingles under the second and third order and whose whole bitmaps still allow the similarity."""

    def run(batches):
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            a, b = col["size_a"].to_numpy(), col["size_b"].to_numpy()
            most = a + b - 2 * -(-num * (a + b) // (num + den))
            keep = []
            lists = [[[np.frombuffer(x.as_buffer(), U64) for x in col[f"{c}_{k}"]] for k in "ab"] for c in ("second", "third")]
            for n, (x, y, m) in enumerate(zip(col["big_a"].to_pylist(), col["big_b"].to_pylist(), most.tolist())):
                size = min(len(x), len(y))
                keep.append(all(_meet(own[n], other[n]) for own, other in lists) and int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= m)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([col["cls_a"].filter(keep), col["cls_b"].filter(keep)], ["cls_a", "cls_b"])

    return run


def _verify(n: int, num: int, den: int):
    """The pairs of texts whose sets are similar enough."""

    def run(batches):
        for whole in batches:
            for batch, raw, off in tx.pieces([whole], "text_a", tx.WORK_BYTES // 2):
                raw_b, off_b = tx.utf8(batch.column(batch.schema.get_field_index("text_b")))
                va, ea = _sets(raw, off, n)
                vb, eb = _sets(raw_b, off_b, n)
                keep, at, bt = [], 0, 0
                for x, y in zip(ea.tolist(), eb.tolist()):
                    a, b = _unique(va[at:x]), _unique(vb[bt:y])
                    at, bt = x, y
                    both = np.sort(np.concatenate([a, b]))
                    same = int((both[1:] == both[:-1]).sum())
                    keep.append(same > 0 and den * same >= num * (len(a) + len(b) - same))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("cls_a", "cls_b", "a", "b")], ["cls_a", "cls_b", "a", "b"])

    return run


def _with_sides(pairs: DataFrame, side, parts: int) -> DataFrame:
    """Pairs (cls_a, cls_b), a table, with the rows that side("a") and side("b") have for them. Rows of keys of at least an eighth of a partition's share of the pairs are repeated, 16 * parts times at most for each side, and such pairs dealt out among them."""
    total = pairs.count()
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cls_{k}").alias("cls")) for k in "ab"])).alias("x")).groupBy("x.k", "x.cls").agg(F.count("*").alias("n"))
    hubs = tx.table(each.where(F.col("n") >= max(2, total // (8 * parts))).select("k", "cls", F.ceil(F.col("n") * (8 * parts) / max(1, total)).cast("int").alias("_parts")), "hubs")
    for k in "ba":
        key = f"cls_{k}"
        if hubs.where(F.col("k") == k).head(1):
            own = F.broadcast(hubs.where(F.col("k") == k).select(F.col("cls").alias(key), "_parts"))
            part = F.coalesce(F.pmod(F.xxhash64("cls_a", "cls_b"), "_parts").cast("int"), F.lit(0))
            pairs = pairs.join(own, key, "left").withColumn("_part", part).drop("_parts")
            more = side(k).join(own, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
            pairs = pairs.join(more, [key, "_part"]).drop("_part")
        else:
            pairs = pairs.join(side(k), key)
    return pairs


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; linked when den * |A & B| >= num * |A | B|."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scan = tx.table(docs.mapInArrow(_profile(n), "doc_id long, n long, d1 long, d2 long, bucket int, counts binary"), "profile")
    sizes = scan.where("bucket is null").select("doc_id", "n", "d1", "d2")
    totals = sizes.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    rows, prefixes = totals["rows"], (totals["n"] or 0) * (den - num) // den + totals["rows"]
    parts = tx.partitions(spark, prefixes * len(_ORDERS) * 24)
    ranks = spark.sparkContext.broadcast(_ranks(scan.where("bucket is not null").select("bucket", "counts"), parts, num, den))
    named = sizes.where("n > 0 and doc_id is not null")
    reps = tx.table(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    texts = docs.where("doc_id is not null")
    blob = "bucket int, token binary, cls binary, pos binary, size binary, ord int"
    found = tx.deal(texts.select("text").mapInArrow(_prefixes(n, num, den, ranks, parts), blob), parts).mapInArrow(_shared(num, den, parts, ranks), blob)
    inc = tx.table(tx.deal(found, parts).mapInArrow(_both, _INC), "prefixes", tidy=True)
    records = inc.agg(F.sum(F.size("tokens"))).first()[0] or 0
    fine = tx.partitions(spark, records * 140)

    def among(frame: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of a frame whose first column may be among the ids: few ids are broadcast, more are a bitmap of bounded size, and beyond that all rows stay."""
        n = ids.count()
        if n <= FEW:
            return frame.join(F.broadcast(ids.toDF("_id")), F.col(frame.columns[0]) == F.col("_id"), "left_semi")
        bits = tx.bitmap_bits(n)
        return tx.only(frame, tx.wanted(ids, bits)) if bits else frame

    def verified(cand: DataFrame) -> DataFrame:
        cand = tx.table(cand.select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b")).distinct(), "candidates")
        classes = among(inc.select("cls", "size", "big", "second", "third"), cand.select("cls_a").union(cand.select("cls_b")))
        whole = lambda k: classes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("cls", "size", "big", "second", "third")])
        near = _with_sides(cand, whole, fine).select("cls_a", "cls_b", *[f"{c}_{k}" for c in ("size", "big", "second", "third") for k in "ab"])
        cand = tx.table(near.mapInArrow(_near(num, den), "cls_a long, cls_b long"), "pairs", tidy=True)
        chosen = tx.table(reps.join(cand.select(F.col("cls_a").alias("d1")).union(cand.select("cls_b")).distinct(), "d1").select(F.col("d1").alias("cls"), "rep"), "chosen")
        own = chosen.join(among(texts, chosen.select("rep")), F.col("rep") == F.col("doc_id")).select("cls", "rep", "text")
        side = lambda k: own.select(F.col("cls").alias(f"cls_{k}"), F.col("rep").alias(k), F.col("text").alias(f"text_{k}"))
        both = _with_sides(cand, side, fine)
        return both.select("cls_a", "cls_b", "a", "b", "text_a", "text_b").mapInArrow(_verify(n, num, den), "cls_a long, cls_b long, a long, b long").distinct()

    def by_token(labelled: DataFrame, hot, everywhere: bool) -> DataFrame:
        return tx.deal(labelled.drop("big", "second", "third").mapInArrow(_by_token(fine, hot, everywhere), _WIDE_ROW), fine)

    alone = inc.withColumn("label", F.col("cls"))
    hot = _hot(alone, ranks, fine, records)
    sent = spark.sparkContext.broadcast(hot)
    first = tx.table(by_token(alone, sent, False).mapInArrow(_stars(num, den, fine, sent), _STAR_ROW), "first", tidy=True)
    pairs = first.where(F.col("kind") == _PAIR).select("a", "b")
    if len(hot.token):
        second = tx.deal(first.where(F.col("kind") == _PIVOT).drop("kind", "a", "b", "place"), fine).mapInArrow(_stars(num, den, fine, None), _STAR_ROW)
        pairs = pairs.union(second.select("a", "b"))
    stars = tx.table(verified(pairs), "stars", tidy=True)
    label = components(stars.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    still = first.where(F.col("kind") == _OPEN).groupBy(F.col("a").alias("cls")).agg(F.collect_list(F.struct("b", "place")).alias("x"))
    still = tx.table(still.select("cls", F.col("x.b").alias("tokens"), F.col("x.place").alias("pos")), "open")
    labelled = among(inc.select("cls", "size", "s0", "s1", "s2", "s3", "bits"), still.select("cls")).join(still, "cls")
    labelled = labelled.join(label.select(F.col("id").alias("cls"), F.col("component").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    if len(hot.token):
        labelled = tx.table(labelled, "labelled")
        hot = _hot(labelled, ranks, fine, records)
    sent = spark.sparkContext.broadcast(hot)
    rest = tx.table(verified(by_token(labelled, sent, True).mapInArrow(_across(num, den, sent), "a long, b long")), "rest", tidy=True)
    links = stars.select("a", "b").union(rest.select("a", "b"))
    same = _same_id(named, reps, parts, rows)
    comp = components(links.union(same) if same else links)
    classes = reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = tx.spread_join(named, classes, ["d1", "d2"], "copies", parts, rows)
    others = sizes.where("not (n > 0 and doc_id is not null)")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(others.select("doc_id", "n", "doc_id"))


def _same_id(named: DataFrame, reps: DataFrame, parts: int, rows: int) -> DataFrame | None:
    """Links between the classes of a doc_id that occurs with several texts."""
    twice = tx.table(named.groupBy("doc_id").agg(F.count("*").alias("k"), F.lit(1).alias("one")).where("k > 1"), "twice")
    if not twice.head(1):
        return None
    own = tx.spread_join(named, twice, ["doc_id"], "k", parts, rows).select("doc_id", "d1", "d2").distinct()
    own = tx.table(tx.spread_join(own, reps, ["d1", "d2"], "copies", parts, rows).select("doc_id", "rep"), "own")
    low = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count("*").alias("k"))
    return tx.spread_join(own, low, ["doc_id"], "k", parts, own.count()).select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a != b")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.9: doc_id, n_shingles, component_id."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of documents with a common shingle, and the closure of the links.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id
"""
