"""Vectorised text kernels and the block shuffle that the operators share.

Texts are handled as UTF-8 bytes straight out of Arrow buffers. A *piece of work* is a few
megabytes of whole texts, so the NumPy temporaries stay bounded however large a batch is.

The *block shuffle* packs fixed-width records of one piece of work into one binary value per
target partition (``blocks``), moves those with ``repartitionById`` and unpacks them on the
other side (``unpack``). It moves the same records as a row shuffle, without the cost of a JVM
row for each.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.deploy import ship
from spindrift.functions.shared import drop, partitions, shared_dir, spread_join, table  # noqa: F401

U64 = np.uint64
WORK_BYTES = 1 << 19
FLUSH_RECORDS = 200_000
BATCH_ROWS = 1000
_MULT = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_APART = np.ones(256, bool)  # all ASCII but letters and digits
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the odd multiplier, mod 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 1024), _MULT, U64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.type != kind:
        column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = WORK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with whole texts of about ``most`` bytes together; a longer text comes alone."""
    lean()
    for batch in batches:
        raw, off = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at), raw[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end
    lean()


def words(raw: np.ndarray, off: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes that aren't ASCII white space, nor (plain) ASCII punctuation."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~(_APART if plain else _SPACE)[raw]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z if ``lower``."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    where = np.arange(int(size.sum())) - np.repeat(at, size)
    value = (_BYTE_LOWER if lower else _BYTE)[raw[where + np.repeat(start, size)]]
    value *= powers(int(size.max()))[where]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each n-word shingle, repeats included; a text with fewer words is one shingle."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    count = np.bincount(doc, minlength=n_docs)
    acc = np.zeros(len(hashes), U64)
    padded = np.concatenate([hashes, np.zeros(n - 1, U64)])
    short = count[doc] < n
    same = np.concatenate([doc, np.full(n - 1, -1)])
    for k in range(n):
        part = padded[k : k + len(hashes)] * powers(n + 1)[k + 1]
        inside = same[k : k + len(hashes)] == doc
        acc += np.where(inside, part, U64(0))
    first = np.cumsum(count) - count
    place = np.arange(len(hashes)) - first[doc]
    keep = np.where(short, place == 0, place <= count[doc] - n)
    width = np.minimum(count[doc], n).astype(U64)
    return doc[keep], mix(acc + width * U64(0xD6E8FEB86659FD93))[keep]


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, value) pairs; doc is ascending already."""
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """A partition number from the upper bits of a hash."""
    return (((key >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def blocks(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket with the records that go there, a binary value for each column."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])
    end = np.append(start[1:], len(order))
    out = [pa.array(sorted_[start].astype(np.int32))]
    for value in columns.values():
        value = np.ascontiguousarray(value[order])
        width = value.itemsize * int(np.prod(value.shape[1:], dtype=np.int64))
        view = memoryview(value.reshape(-1).view(np.uint8))  # Arrow would keep what a view stands on: it gets bytes
        out.append(pa.array([bytes(view[s * width : e * width]) for s, e in zip(start.tolist(), end.tolist())], pa.binary()))
    del order, sorted_, value, view
    yield pa.RecordBatch.from_arrays(out, ["bucket", *columns])
    out.clear()


def unpack(batches: Iterable[pa.RecordBatch], kinds: dict[str, tuple]) -> dict[str, np.ndarray]:
    """All records of a partition. kinds: name -> (dtype, trailing shape)."""
    lean()
    parts: dict[str, list] = {k: [] for k in kinds}
    for batch in batches:
        for k, (dtype, shape) in kinds.items():
            raw, _ = utf8(batch.column(batch.schema.get_field_index(k)))
            parts[k].append(np.frombuffer(raw.tobytes(), dtype).reshape(-1, *shape))
    out = {}
    for k, (dtype, shape) in kinds.items():
        own = parts.pop(k)
        out[k] = np.concatenate(own) if own else np.zeros((0, *shape), dtype)
    return out


BITMAP_BITS = 23, 28  # a bitmap of ids has 1 to 32 MB


def bitmap_bits(n: int) -> int | None:
    """Bits (as a power of two) of a bitmap for n ids that passes few others; None where it would be larger than the bound."""
    bits = max(BITMAP_BITS[0], (8 * max(n, 1)).bit_length())
    return bits if bits <= BITMAP_BITS[1] else None


def wanted(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of hashed ids: a first filter for rows to be joined with the ids. It is put together in slices of 2**20 bits."""
    slices = 1 << (bits - 20)
    width = (1 << bits) // 8 // slices
    kind = "bucket int, bits binary"

    def row(k: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["bucket", "bits"])

    def deal_ids(batches):
        for batch in batches:
            h = mix(batch.column(0).to_numpy().astype(np.int64).view(U64))
            for b in blocks((h >> U64(64 - (bits - 20))).astype(np.int32), {"bits": h}):
                yield b

    def mark(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = own.setdefault(k, np.zeros(width, np.uint8))
                place = (np.frombuffer(part.as_buffer(), U64) >> U64(64 - bits)).astype(np.int64) - k * width * 8
                np.bitwise_or.at(seen, place >> 3, (np.uint8(128) >> (place & 7).astype(np.uint8)))
        for k, seen in own.items():
            yield row(k, seen)

    out = np.zeros((slices, width), np.uint8)
    for r in deal(ids.mapInArrow(deal_ids, kind), slices).mapInArrow(mark, kind).toLocalIterator():
        out[r["bucket"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def only(frame: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows whose first column, a long, is in the bitmap; a few others may stay."""
    sent = frame.sparkSession.sparkContext.broadcast(bitmap)
    shift = U64(64 - int(np.log2(len(bitmap) * 8)))

    def run(batches):
        seen = sent.value
        for batch in batches:
            place = (mix(batch.column(0).to_numpy().astype(np.int64).view(U64)) >> shift).astype(np.int64)
            yield batch.filter(pa.array((seen[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))

    return frame.mapInArrow(run, frame.schema)


def _thrifty() -> None:
    """Large arrays come from the system and go back to it when they are freed, so that a reused Python worker stays small."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        libc = ctypes.CDLL(None)
        for option, value in ((-8, 1), (-3, 1 << 18), (-1, 1 << 20)):  # M_ARENA_MAX, M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, value)


_thrifty()


def lean() -> None:
    """Free what the worker's earlier tasks left in reference cycles and hand memory back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Send the package's sources to the workers and keep Arrow batches small, as texts can be long."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def deal(frame: DataFrame, n: int) -> DataFrame:
    """Send each row to the partition that its bucket names."""
    return frame.repartitionById(n, F.col("bucket"))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files lie; SPINDRIFT_VOCAB_DIR or a parameter of the operators changes it."""
    return os.path.join(os.environ.get("SPINDRIFT_VOCAB_DIR", "/opt/tokenizers"), name)
