"""Removal of byte strings that an earlier document has, by range-partitioned sorted suffixes.

A byte goes when it is covered by a string of ``length`` bytes that also starts in a document with
a smaller doc_id. Sorting every suffix of a corpus would move each byte many times over the network,
so suffixes are sorted only where a repeat is possible and undecided:

1. Anchors. In each string of ``length`` bytes the 16-gram with the smallest hash is its anchor
   (leftmost of equals), so equal strings have equal anchors at equal offsets. About 6 % of all
   positions are anchors. With each anchor go a hash of its gram, a hash of its context (all bytes
   that a string around it can cover, and where the text ends) and the document, as packed blocks
   by gram. Within a task, equal contexts leave only their first document.
2. By gram: a context that an earlier document has as well (40 bits of the gram's hash and 56 of the
   context's) marks all its strings. A gram with one context marks nothing. What is left are first
   holders of contexts around grams that have several contexts: edges of passages and near copies.
3. Those suffixes, starting at every offset of the string around the anchor, are range-partitioned
   by the leading bytes of the anchor with sampled splitters, and each bucket sorts them by
   multikey quicksort, eight bytes at a time and only among ties. Runs that agree in ``length``
   bytes give the smallest document; real bytes are compared here. A splitter never parts equal
   leading bytes: all of an anchor's suffixes meet in one bucket, so no run crosses a boundary.
   Hot grams, found in the same bounded sample, would fill a task: their records are spread by
   context in step 2 and taken as undecided. Their suffixes go by a few neighbouring offsets at a
   time, to where the bytes that all of these cover lead (all but three of ``length``, or a twelfth),
   and equal ones leave only their first document within a task.
4. Marks go back to their documents, whose compressed texts are shuffled once for both uses.

``compare_all`` leaves step 2 out: every anchor's suffixes are sorted, and no byte is removed without
having been compared. That moves some seven bytes for each byte of text.

Defined cases: null or empty text: 0 bytes, nothing removed. Null doc_id: its row is returned with
nothing removed and counts as no document's source. A doc_id that occurs several times is several
texts of one rank: none of them removes from another, each is judged against smaller ids. Ties of
equal strings are all removed but in the smallest doc_id. Empty table: no rows. Extra columns are
not looked at. Long texts are single units of work: their NumPy arrays take some 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import _text as tx

U64, I64 = np.uint64, np.int64
K = 16
SAMPLED_DOCS = 2000
SAMPLED_EACH = 32
_PIECE = 1 << 19
_SORTED = 200_000


def _words8(raw: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each position of ``room`` zero bytes, raw and as many zeros, little-endian, as a view."""
    pad = np.concatenate([np.zeros(room, np.uint8), raw, np.zeros(room + 8, np.uint8)])
    return np.ndarray((len(pad) - 7,), "<u8", pad.data, 0, (1,))


def _slide(x: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over every window of ``width`` values."""
    step = 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def _gram_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of 16 bytes, given as two little-endian words; neither 0 nor the largest value."""
    h = first * U64(0x9E3779B97F4A7C15) + (second ^ (second >> U64(29))) * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    np.minimum(h, U64(2**64 - 2), out=h)
    h += U64(1)
    return h


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, gram hash and text number of each anchor."""
    n = len(raw)
    none = np.zeros(0, I64)
    if n < length:
        return none, none.view(U64), none
    width = length - K + 1
    w = _words8(raw, 16)
    first, second = w[16 : 16 + n], w[24 : 24 + n]
    h = _gram_hash(first, second)
    end = np.repeat(off[1:], np.diff(off))
    room = end - np.arange(n)
    h[room < K] = U64(2**64 - 1)
    low = _slide(h, width, np.minimum)
    low[room[: len(low)] < length] = 0
    padded = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width, U64)])
    top = _slide(padded, width, np.maximum)[:n]
    at = np.flatnonzero((top == h) & (room >= K))
    return at, h[at], np.searchsorted(off, at, "right") - 1


def _contexts(raw: np.ndarray, off: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes that strings around each anchor can cover, and of how many there are on either side."""
    before = np.minimum(length - K, at - off[doc])
    after = np.minimum(length, off[doc + 1] - at)
    w = _words8(raw, length)
    h = np.zeros(len(at), U64)
    full = U64(2**64 - 1)
    eight = U64(8)
    for j in [*range(-(length - K), length - 8, 8), length - 8]:
        value = w[at + (length + j)]
        skip = np.clip(-before - j, 0, 8)
        take = np.clip(after - j, 0, 8)
        mask = np.where(take == 8, full, (U64(1) << (np.minimum(take, 7).astype(U64) * eight)) - U64(1))
        mask &= np.where(skip == 8, U64(0), full << (np.minimum(skip, 7).astype(U64) * eight))
        h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15) + tx.mix((value & mask) + U64(j + 4096))
    return tx.mix(h + before.astype(U64) * U64(0x632BE59BD9B4E019) + after.astype(U64) * U64(0xD1342543DE82EF95))


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def _from_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").reshape(-1).astype(U64)


_KINDS = {"gram": (np.uint8, (5,)), "ctx": (np.uint8, (7,)), "doc": (I64, ()), "uid": (I64, ()), "lo": (np.uint16, ()), "hi": (np.uint16, ())}
_MARK = {"uid": (I64, ()), "pos": (np.uint32, ()), "kind": (np.uint8, ())}
_A = "bucket int, gram binary, ctx binary, doc binary, uid binary, lo binary, hi binary, mark boolean"
FULL, PART = 1, 2


def _screen(length: int, parts: int, same: bool, hot: np.ndarray):
    """Step 1. same: uid is doc_id and doesn't travel twice. hot: common grams, whose records are spread by context."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        count = 0

        def flush():
            gram, ctx, doc, uid, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, ctx, gram))
            g, c, d = gram[order], ctx[order], doc[order]
            lead = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            later = d != d[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            known = np.zeros(len(g), bool)
            known[order] = later
            yield from send(gram, ctx, doc, uid, pos, ~known, tx.bucket_of(tx.mix(np.where(np.isin(gram, hot), gram ^ tx.mix(ctx), gram)), parts), False)  # anchors have small hashes: mixed once more they spread evenly
            yield from send(gram, ctx, doc, uid, pos, known, tx.bucket_of(tx.mix(uid.view(U64)), parts), True)
            held.clear()

        def send(gram, ctx, doc, uid, pos, keep, bucket, mark):
            if not keep.any():
                return
            pos = pos[keep]
            nothing = np.zeros((len(pos), 0), np.uint8)
            cols = {
                "gram": nothing if mark else _low_bytes(gram[keep], 5), "ctx": nothing if mark else _low_bytes(ctx[keep], 7),
                "doc": nothing if mark else doc[keep], "uid": nothing if same and not mark else uid[keep],
                "lo": (pos & 0xFFFF).astype(np.uint16), "hi": (pos >> 16).astype(np.uint16),
            }
            for b in tx.blocks(bucket[keep], cols):
                yield b.append_column("mark", pa.array(np.full(b.num_rows, mark)))

        for rows, raw, off in tx.pieces(batches, "text", _PIECE):
            at, gram, doc = anchors(raw, off, length)
            if len(at):
                ids, uids = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "uid"))
                held.append([gram, _contexts(raw, off, at, doc, length), ids[doc], uids[doc], at - off[doc]])
                count += len(at)
            if count > tx.FLUSH_RECORDS:
                yield from flush()
                count = 0
        if held:
            yield from flush()
        tx.lean()

    return run


def _marks(uid, pos, kind, parts):
    return tx.blocks(tx.bucket_of(tx.mix(uid.view(U64)), parts), {"uid": uid, "pos": pos.astype(np.uint32), "kind": kind})


def _decide(parts: int, same: bool, hot: np.ndarray):
    """Step 2: marks for anchors whose context an earlier document has, and for those whose suffixes must be sorted. Hot grams have several contexts."""
    hot = hot & U64((1 << 40) - 1)

    def run(batches):
        own = []
        for batch in batches:
            mark = batch.column(batch.schema.get_field_index("mark"))
            done = batch.filter(mark)
            if done.num_rows:
                r = tx.unpack([done], {k: _KINDS[k] for k in ("uid", "lo", "hi")})
                yield from _marks(r["uid"], r["lo"].astype(np.uint32) | (r["hi"].astype(np.uint32) << 16), np.full(len(r["uid"]), FULL, np.uint8), parts)
            if done.num_rows < batch.num_rows:
                own.append(batch.filter(pa.compute.invert(mark)))
        r = tx.unpack(own, {k: v for k, v in _KINDS.items() if not (same and k == "uid")})
        own.clear()
        if not len(r["doc"]):
            return
        gram, ctx, doc = _from_bytes(r.pop("gram")), _from_bytes(r.pop("ctx")), r["doc"]
        order = np.lexsort((doc, ctx, gram))
        gram, ctx, doc = gram[order], ctx[order], doc[order]
        uid = doc if same else r["uid"][order]
        pos = (r["lo"].astype(np.uint32) | (r["hi"].astype(np.uint32) << 16))[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_ctx = new_gram | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        lead = np.flatnonzero(new_ctx)
        later = doc != doc[lead[np.cumsum(new_ctx) - 1]]
        start = np.flatnonzero(new_gram)
        number = np.cumsum(new_gram) - 1
        several = (np.add.reduceat(new_ctx.astype(I64), start) > 1) & (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
        part = ~later & (several[number] | np.isin(gram, hot))
        for keep, kind in ((later, FULL), (part, PART)):
            if keep.any():
                yield from _marks(uid[keep], pos[keep], np.full(int(keep.sum()), kind, np.uint8), parts)
        del r, gram, ctx, doc, uid, pos, order, later, number, part, new_gram, new_ctx
        tx.lean()

    return run


def _rows_by_uid(batches):
    """One row for each document: its positions of either kind."""
    r = tx.unpack(batches, _MARK)
    if not len(r["uid"]):
        return
    order = np.lexsort((r["pos"], r["kind"], r["uid"]))
    uid, pos, kind = r["uid"][order], r["pos"][order], r["kind"][order]
    start = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
    split = start + np.add.reduceat((kind == FULL).astype(I64), start)
    end = np.append(start[1:], len(uid))
    full = [pos[s:m].tobytes() for s, m in zip(start.tolist(), split.tolist())]
    part = [pos[m:e].tobytes() if e > m else None for m, e in zip(split.tolist(), end.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(uid[start]), pa.array(full, pa.binary()), pa.array(part, pa.binary())], ["uid", "full", "part"])


def _pack(batches):
    """Texts as zstd frames; further columns go along."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        rest = batch.schema.names[3:]
        raw, off = tx.utf8(batch.column(batch.schema.get_field_index("text")))
        view = memoryview(raw)
        z = [codec.compress(view[s:e], asbytes=True) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("uid")), batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(off)), pa.array(z, pa.binary()), *batch.columns[3:]], ["uid", "doc_id", "n_bytes", "z", *rest])


def _unzip(batch, codec):
    n = batch.column(batch.schema.get_field_index("n_bytes")).to_pylist()
    for size, z in zip(n, batch.column(batch.schema.get_field_index("z"))):
        yield np.frombuffer(codec.decompress(z.as_buffer(), size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def _suffix_kinds(length: int) -> dict:
    return {"ctx": (np.uint8, (2 * length - K,)), "before": (np.uint16, ()), "after": (np.uint16, ()), "doc": (I64, ()), "uid": (I64, ()), "pos": (np.uint32, ())}


def _halves(length: int) -> tuple:
    """Columns of a context that strings share if they reach far to the right, or far to the left, of the anchor."""
    left = length - K
    half = left // 2
    return (left, left + length - half), (left - half - 1, left + K)


def _offset_blocks(length: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring offsets at which strings around an anchor start before it."""
    step = max(4, length // 12)
    return [(low, min(length - K, low + step - 1)) for low in range(0, length - K + 1, step)]


WHOLE, BLOCK, SPAN = 0, 1, 2  # forms of rows on their way to a bucket
_PLACE = {"doc": (I64, ()), "uid": (I64, ()), "pos": (np.uint32, ())}


def _block_kinds(length: int) -> dict:
    low, high = _offset_blocks(length)[0]
    return {"ctx": (np.uint8, (length + high - low,)), "base": (np.uint16, ()), "low": (np.uint16, ()), "high": (np.uint16, ()), **_PLACE}


_SPREAD = "bucket int, form int, ctx binary, before binary, after binary, doc binary, uid binary, pos binary, base binary, low binary, high binary"


def _form(blocks, form: int):
    names = [x.split()[0] for x in _SPREAD.split(", ")]
    for b in blocks:
        own = dict(zip(b.schema.names, b.columns)) | {"form": pa.array(np.full(b.num_rows, form, np.int32))}
        yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(b.num_rows, pa.binary()) for c in names], names)


def _common(length: int, parts: int, ctx, before, after, doc, uid, pos):
    """Suffixes around hot grams: a record for each range of offsets, with the bytes that they cover."""
    left = length - K
    ranges = _offset_blocks(length)
    width = _block_kinds(length)["ctx"][1][0]
    out = []
    for low, high in ranges:
        least, most = np.maximum(low, length - after.astype(I64)), np.minimum(high, before.astype(I64))
        own = np.flatnonzero(least <= most)
        if not len(own):
            continue
        union = np.zeros((len(own), width), np.uint8)
        union[:, : length + high - low] = ctx[own, left - high : left - low + length]
        key = _hash_columns(union) ^ tx.mix((least[own] * 65536 + most[own]).astype(U64))
        order = np.lexsort((doc[own], key))
        own, union, key = own[order], union[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc[own] > doc[own[first]]) & (union == union[first]).all(1)
        gone &= (least[own] == least[own[first]]) & (most[own] == most[own[first]])
        if gone.any():
            g = own[gone]
            begin, end = pos[g].astype(I64) - most[g], pos[g].astype(I64) - least[g] + length
            yield from _form(tx.blocks(tx.bucket_of(tx.mix(uid[g].view(U64)), parts), {"uid": uid[g], "low": begin.astype(np.uint32), "high": end.astype(np.uint32)}), SPAN)
        k = own[~gone]
        core = np.ascontiguousarray(union[~gone][:, high - low : length])
        home = tx.bucket_of(tx.mix(_hash_columns(core) + U64(low)), parts)
        out.append((home, union[~gone], np.full(len(k), high, np.uint16), least[k].astype(np.uint16), most[k].astype(np.uint16), doc[k], uid[k], pos[k]))
    if out:
        home, *columns = (np.concatenate(x) for x in zip(*out))
        yield from _form(tx.blocks(home, dict(zip(_block_kinds(length), columns))), BLOCK)


def _spread(length: int, parts: int, splitters: np.ndarray, hot: np.ndarray):
    """Step 3, sending: the bytes around each undecided anchor, to the range that its leading bytes fall in; around a hot gram, by ranges of offsets."""
    left = length - K

    def run(batches):
        codec = pa.Codec("zstd")
        held: list[list] = []
        count = 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            ctx = columns[0]
            if len(hot):
                first, second = (np.ascontiguousarray(ctx[:, left + i : left + i + 8]).view("<u8").reshape(-1).astype(U64) for i in (0, 8))
                common = np.isin(_gram_hash(first, second), hot)
                if common.any():
                    yield from _common(length, parts, *[x[common] for x in columns])
                    columns = [x[~common] for x in columns]
                    ctx = columns[0]
            lead = np.ascontiguousarray(ctx[:, left : left + 8]).view(">u8").reshape(-1).astype(U64)
            yield from _form(tx.blocks(np.searchsorted(splitters, lead, "right").astype(np.int32), dict(zip(_suffix_kinds(length), columns))), WHOLE)

        for batch in batches:
            uid, doc = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("uid", "doc_id"))
            part = batch.column(batch.schema.get_field_index("part"))
            for k, raw in enumerate(_unzip(batch, codec)):
                pos = np.frombuffer(part[k].as_py(), np.uint32)
                pad = np.concatenate([np.zeros(left, np.uint8), raw, np.zeros(length, np.uint8)])
                windows = np.lib.stride_tricks.sliding_window_view(pad, 2 * length - K)
                step = max(1, (6 << 20) // (2 * length - K))
                for low in range(0, len(pos), step):  # long texts in parts
                    own = pos[low : low + step]
                    m, at = len(own), own.astype(I64)
                    held.append([windows[at], np.minimum(left, at).astype(np.uint16), np.minimum(length, len(raw) - at).astype(np.uint16), np.full(m, doc[k], I64), np.full(m, uid[k], I64), own])
                    count += m
                    if count >= step:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    return run


def equal_runs(data: np.ndarray, place: np.ndarray, depth: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes of data (bytes) at the given places, eight bytes being a character: (suffix numbers, run numbers) of those that agree with another one in ``depth`` bytes and in group."""
    word = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,))
    at = np.arange(len(place))
    for step in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        key = word[place[at] + step].astype(U64)
        order = np.lexsort((key, group))
        at, group, key = at[order], group[order], key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        number = np.cumsum(new) - 1
        tied = np.bincount(number)[number] > 1
        at, group = at[tied], number[tied]
        if not len(at):
            break
    return at, group


def _hash_columns(x: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    h = np.zeros(len(x), U64)
    for k, w in enumerate(wide.view("<u8").T):
        h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15) + tx.mix(w.astype(U64) + U64(k))
    return tx.mix(h)


def _sort_bucket(length: int, parts: int):
    """Step 3, receiving: sorts the suffixes of a range and marks the strings that an earlier document has.

    A string around an anchor reaches at least half of the way it can to one side, so its suffixes
    need sorting only among contexts that agree on that half; those of a range of offsets only among
    records that agree on the bytes that all of them cover.
    """
    left = length - K
    half = left // 2

    def run(batches):
        forms: dict[int, list] = {WHOLE: [], BLOCK: [], SPAN: []}
        for batch in batches:
            form = batch.column(batch.schema.get_field_index("form")).to_numpy()
            for k, own in forms.items():
                if (form == k).any():
                    own.append(batch.filter(pa.array(form == k)))
        r = tx.unpack(forms.pop(SPAN), {"uid": (I64, ()), "low": (np.uint32, ()), "high": (np.uint32, ())})
        yield from tx.blocks(tx.bucket_of(tx.mix(r["uid"].view(U64)), parts), {"uid": r["uid"], "begin": r["low"], "end": r["high"]})
        r = tx.unpack(forms.pop(WHOLE), _suffix_kinds(length))
        if len(r["doc"]):
            r["ctx"] = np.ascontiguousarray(r["ctx"])
            before, after = r["before"].astype(I64), r["after"].astype(I64)
            right, back = _halves(length)
            for low, high, (begin, end), whole in ((0, half, right, after >= length - half), (half + 1, left, back, before >= half + 1)):
                rows = np.flatnonzero(whole)
                key = np.concatenate([np.zeros(0, U64), *[_hash_columns(r["ctx"][rows[i : i + 20_000], begin:end]) for i in range(0, len(rows), 20_000)]])
                own = {c: r[c] for c in ("ctx", "doc", "uid", "pos")} | {"base": np.full(len(before), left), "least": np.maximum(low, length - after), "most": np.minimum(high, before)}  # offsets of strings that lie within the text
                yield from groups(own, rows, key, high - low + 1)
        r = tx.unpack(forms.pop(BLOCK), _block_kinds(length))
        if len(r["doc"]):
            r["ctx"] = np.ascontiguousarray(r["ctx"])
            wide = {high: low for low, high in _offset_blocks(length)}
            for high in np.unique(r["base"]).tolist():
                rows = np.flatnonzero(r["base"] == high)
                key = _hash_columns(np.ascontiguousarray(r["ctx"][rows, high - wide[high] : length])) + U64(high)
                own = {c: r[c] for c in ("ctx", "doc", "uid", "pos")} | {"base": r["base"].astype(I64), "least": r["low"].astype(I64), "most": r["high"].astype(I64)}
                yield from groups(own, rows, key, high - wide[high] + 1)
        r.clear()
        tx.lean()

    def groups(r, rows, key, offsets):
        """Goes through the rows that have a key in common, if they are of several documents."""
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        if not len(rows):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        doc = r["doc"][rows]
        shared = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        size = np.diff(np.append(start, len(rows)))
        rows, group = rows[np.repeat(shared, size)], np.repeat(np.arange(shared.sum()), size[shared])
        bound = np.append(np.cumsum(size[shared]) - size[shared], len(rows))
        at, most = 0, max(1, _SORTED // offsets)
        while at < len(bound) - 1:
            to = max(at + 1, int(np.searchsorted(bound, bound[at] + most, "right")) - 1)
            own, names = rows[bound[at] : bound[to]], group[bound[at] : bound[to]]
            part = {k: v[own] for k, v in r.items()}
            step = max(1, _SORTED // len(own))  # a large group goes by a few offsets at a time: equal strings have equal ones
            low, high = int(part["least"].min()), int(part["most"].max())
            for o in range(low, high + 1, step):
                yield from solve(part, names, o, min(high, o + step - 1))
            at = to

    def solve(r, group, low, high):
        m, width = r["ctx"].shape
        least, most = np.maximum(low, r["least"]), np.minimum(high, r["most"])
        count = np.maximum(0, most - least + 1)
        row = np.repeat(np.arange(m), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + least[row]
        if not len(row):
            return
        data = np.ascontiguousarray(r["ctx"]).reshape(-1)
        at, run_ = equal_runs(data, row * width + r["base"][row] - offset, length, group[row] * (left + 1) + offset)
        if not len(at):
            return
        cut = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
        doc = r["doc"][row[at]]
        first = np.minimum.reduceat(doc, cut)
        gone = at[doc > np.repeat(first, np.diff(np.append(cut, len(at))))]
        if not len(gone):
            return
        hit = np.zeros((m, high - low + 3), np.int8)
        hit[row[gone], offset[gone] - low + 1] = 1
        edge = np.diff(hit, axis=1)
        r1, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        pos = r["pos"].astype(I64)[r1]
        uid = r["uid"][r1]
        yield from tx.blocks(tx.bucket_of(tx.mix(uid.view(U64)), parts), {"uid": uid, "begin": (pos - (low + b - 1)).astype(np.uint32), "end": (pos - (low + a) + length).astype(np.uint32)})

    return run


def _spans_by_uid(batches):
    r = tx.unpack(batches, {"uid": (I64, ()), "begin": (np.uint32, ()), "end": (np.uint32, ())})
    if not len(r["uid"]):
        return
    order = np.argsort(r["uid"], kind="stable")
    uid = r["uid"][order]
    pair = np.stack([r["begin"][order], r["end"][order]], 1)
    start = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
    end = np.append(start[1:], len(uid))
    yield pa.RecordBatch.from_arrays([pa.array(uid[start]), pa.array([pair[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())], pa.binary())], ["uid", "spans"])


def _joined(start: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals; those at most ``gap`` apart are one."""
    if not len(start):
        return start, end
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1] + gap])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def removed_spans(raw: np.ndarray, full: bytes | None, spans: bytes | None, length: int, least_bytes: int = 0, over_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (starts, ends) of a text. A run of places at each of which a repeated string starts counts only if the strings cover ``least_bytes`` bytes together, or more than ``over_words`` words."""
    pos = np.frombuffer(full or b"", np.uint32).astype(I64)
    pair = np.frombuffer(spans or b"", np.uint32).astype(I64).reshape(-1, 2)
    first = np.concatenate([np.maximum(0, pos - (length - K)), pair[:, 0]])
    last = np.minimum(len(raw) - length, np.concatenate([pos, pair[:, 1] - length]))
    start, end = _joined(first, last, 1)
    end = end + length
    if least_bytes and len(start):
        keep = end - start >= least_bytes
        if over_words is not None:
            solid = ~tx._SPACE[raw]
            begins = np.concatenate([[0], np.cumsum(solid[1:] & ~solid[:-1])])  # words that begin after a place
            keep |= begins[end - 1] - begins[start] + solid[start] > over_words
        start, end = start[keep], end[keep]
    return _joined(start, end, 0)


def _digest(length: int):
    """Step 4: counts and the digest of what is left."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            full, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("full", "spans"))
            n_removed, n_spans, sha = [], [], []
            for k, raw in enumerate(_unzip(batch, codec)):
                start, end = removed_spans(raw, full[k], spans[k], length)
                n_removed.append(int((end - start).sum()))
                n_spans.append(len(start))
                digest, at = hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist()):
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _keep_text(length: int, rest: list[str], least_bytes: int, over_words: int | None):
    """Step 4: the text that is left; bytes of a character that was cut in two go as well."""
    names = ["doc_id", "text", "changed", *rest]

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            full, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("full", "spans"))
            out, changed = [], []
            for k, raw in enumerate(_unzip(batch, codec)):
                start, end = removed_spans(raw, full[k], spans[k], length, least_bytes, over_words)
                keep = np.ones(len(raw), bool)
                for s, e in zip(start.tolist(), end.tolist()):
                    keep[s:e] = False
                out.append(raw[keep].tobytes().decode("utf-8", "ignore"))
                changed.append(len(start) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(out, pa.string()), pa.array(changed, pa.bool_()), *[batch.column(batch.schema.get_field_index(c)) for c in rest]], names)

    return run


def _sampled(docs: DataFrame, total: int, length: int, parts: int, hot_from: int | None) -> tuple[np.ndarray, np.ndarray]:
    """From anchors of about SAMPLED_DOCS texts, SAMPLED_EACH of a text: at most parts - 1 leading eight-byte values that part them evenly, and the hot grams, those that make up an eighth of a partition's share and occur 8 times at least, or else ``hot_from`` times. The sample bears on balance alone, not on the result."""

    def run(batches):
        for _, raw, off in tx.pieces(batches, "text", _PIECE):
            at, gram, doc = anchors(raw, off, length)
            order = np.lexsort((gram, doc))
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            chosen = at[order][rank < SAMPLED_EACH]
            leads = _words8(raw, 16)[16:][chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, ::-1]
            yield pa.RecordBatch.from_arrays([pa.array([leads.tobytes()], pa.binary()), pa.array([gram[order][rank < SAMPLED_EACH].tobytes()], pa.binary())], ["leads", "grams"])

    chosen = docs.where(F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(max(1, total // SAMPLED_DOCS))) == 0).select("text")
    rows = chosen.mapInArrow(run, "leads binary, grams binary").collect()
    leads, grams = (np.concatenate([np.zeros(0, U64), *[np.frombuffer(bytes(r[c]), "<u8").astype(U64) for r in rows]]) for c in ("leads", "grams"))
    if not len(leads):
        return leads, grams
    leads.sort()
    grams, count = np.unique(grams, return_counts=True)
    return np.unique(leads[(np.arange(1, parts) * len(leads)) // parts]), grams[count >= (hot_from or max(8, len(leads) / (8 * parts)))]


def _all_anchors(length: int):
    """Every anchor of every text as one whose suffixes are to be sorted."""

    def run(batches):
        for rows, raw, off in tx.pieces(batches, "text", _PIECE):
            at, _, doc = anchors(raw, off, length)
            uid = rows.column(rows.schema.get_field_index("uid")).to_numpy()
            bound = np.searchsorted(doc, np.arange(len(off)))
            part = [(at[a:b] - off[k]).astype(np.uint32).tobytes() if b > a else None for k, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist()))]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.nulls(len(uid), pa.binary()), pa.array(part, pa.binary())], ["uid", "full", "part"])

    return run


def mark_repeats(docs: DataFrame, length: int = 50, hot_from: int | None = None, compare_all: bool = False) -> DataFrame:
    """(uid, doc_id, n_bytes, z, full, spans) of the rows of (uid, doc_id, text), and the columns that follow those; uid identifies a row and is doc_id where that is unique."""
    if length < 24:
        raise ValueError("strings of fewer than 24 bytes aren't supported")
    spark = docs.sparkSession
    texts = docs.select("uid", "doc_id", "text")
    total = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.max(F.col("uid") != F.col("doc_id")).alias("other")).first()
    parts = tx.partitions(spark, 2 * (total["size"] or 0))  # the records of step 1 take up to twice the bytes of the texts
    same = not total["other"]
    fine = 2 * parts
    splitters, hot = _sampled(texts, total["n"], length, fine, hot_from)
    if compare_all:
        marks = texts.mapInArrow(_all_anchors(length), "uid long, full binary, part binary")
    else:
        found = tx.deal(texts.mapInArrow(_screen(length, fine, same, hot), _A), fine).mapInArrow(_decide(parts, same, hot), "bucket int, uid binary, pos binary, kind binary")
        marks = tx.table(tx.deal(found, parts).mapInArrow(_rows_by_uid, "uid long, full binary, part binary"), "marks", tidy=True)
    shape = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("z", T.BinaryType()), *docs.schema.fields[3:]])
    packed = docs.mapInArrow(_pack, shape).where("uid is not null").repartition(parts, "uid")
    open_ = packed.join(marks.where("part is not null").select("uid", "part").hint("shuffle_merge"), "uid")
    spread = tx.deal(open_.mapInArrow(_spread(length, fine, splitters, hot), _SPREAD), fine)
    spans = tx.deal(spread.mapInArrow(_sort_bucket(length, parts), "bucket int, uid binary, begin binary, end binary"), parts).mapInArrow(_spans_by_uid, "uid long, spans binary")
    return packed.join(marks.select("uid", "full").hint("shuffle_merge"), "uid", "left").join(spans.hint("shuffle_merge"), "uid", "left")


def with_uid(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text, other columns) of the rows that have a doc_id. Where a doc_id occurs twice, uid is a hash of id and text, so equal rows share it."""
    docs = docs.where("doc_id is not null")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1)
    return docs.select((F.xxhash64("doc_id", "text") if twice else F.col("doc_id")).alias("uid"), "doc_id", "text", *rest)


def remove_repeats(docs: DataFrame, length: int = 50, least_bytes: int = 0, over_words: int | None = None, changed: str = "__changed") -> DataFrame:
    """The rows with the text that is left, and whether it changed, in a column of the given name; a null text becomes an empty one where its row has a doc_id. See ``removed_spans`` for least_bytes and over_words."""
    rest = {f"__{k}": c for k, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}  # their own names could clash
    own = with_uid(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for k, c in rest.items()]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType()), *own.schema.fields[3:]])
    found = mark_repeats(own, length).mapInArrow(_keep_text(length, list(rest), least_bytes, over_words), schema)
    back = {c: k for k, c in rest.items()}
    return found.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns], F.col("changed").alias(changed)).union(
        docs.where("doc_id is null").select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(False))
    )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """50-byte strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def repeat_digests(docs: DataFrame, length: int = 50, hot_from: int | None = None, compare_all: bool = False) -> DataFrame:
    """What is removed of each row of (doc_id, text), and the digest of what is left."""
    found = mark_repeats(with_uid(docs), length, hot_from, compare_all).mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.union(docs.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(text, 256)))


#: Every byte string as two hexadecimal digits a byte.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2)) AS i, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 100))) AS w FROM d),
f AS (SELECT doc_id, i, substr(w, 1, 2) AS b, CASE WHEN length(w) = 100 AND min(doc_id) OVER (PARTITION BY w) < doc_id THEN 1 ELSE 0 END AS start FROM p),
c AS (SELECT doc_id, i, b, max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
t AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
