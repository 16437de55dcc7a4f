"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. A seed is the hash of the words
under a fixed mask that ignores the positions in between. Where a document's seed equals one of the
benchmark's, the two are aligned there without gaps and compared word by word. An item leaks if

* it lies whole in the document and at least 80 % of its words agree, wherever the others stand, or
* a stretch of at least ``least`` words (13), starting and ending with equal words, agrees in 80 %, or
* it has fewer than ``SHORTEST`` words (5) and is all the words of the document.

Items of ``least`` words and more have the four masks of weight six below. They leave no gap: 13 words
and more with substitutions in up to a fifth hold a seed of some mask that avoids all of them (shown
by enumeration in the tests). Shorter items may have n // 5 substitutions; their masks, as long as the
item, take every (n // 5 + 1)-th word, so one of them avoids all substitutions.

The seeds of the benchmark are broadcast in blocks of items with about ``block_words`` words, so
the broadcast is bounded however large the benchmark is; each block scans the documents once.
Documents aren't shuffled. The result has one row for each leaking (document, item).

Defined cases: null or empty texts hold no words; null item_id or doc_id: the row takes no part. An
item_id or doc_id that occurs several times gives one row with its best stretch (longest, then most
equal words, then first in the item, then in the document). Empty tables: no rows. Extra columns, whatever
their names, are not looked at. Pairs of equal seeds are gone through in steps of bounded size, so texts
of one repeated word take time in proportion to the pairs and no more memory than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import _text as tx

U64, I64 = np.uint64, np.int64
MASKS = ("1111011", "1100010111", "101100111", "111111")
LEAST = 13
SHORTEST = 5
_BITS = 22
_STEP = 1_000_000  # pairs of equal seeds at a time


def _seeds(words: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the mask at every place within one text."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, I64), np.zeros(0, U64)
    acc = np.zeros(n, U64)
    power = tx.powers(64)
    for k, bit in enumerate(mask):
        if bit == "1":
            acc += words[k : k + n] * power[k + 1]
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    return at, acc[at]


def short_masks(n: int) -> list[str]:
    """Masks of an item of n words, fewer than LEAST."""
    apart = n // 5 + 1 if n >= SHORTEST else 1
    return ["".join("1" if k % apart == r else "0" for k in range(n)) for r in range(apart)]


class Seeds:
    """A block of benchmark items."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, off: np.ndarray, least: int):
        start, end, item = tx.words(raw, off, plain=True)
        self.least, self.ids = least, ids
        self.word = tx.word_hashes(raw, start, end)
        count = np.bincount(item, minlength=len(ids))
        self.begin = np.cumsum(count) - count
        self.count = count
        self.tables = []
        for n in [0, *sorted({int(c) for c in count if 0 < c < least})]:
            for mask in short_masks(n) if n else MASKS:
                at, key = _seeds(self.word, item, mask)
                fit = (count[item[at]] == n) & (at == self.begin[item[at]]) if n else count[item[at]] >= least
                at, key = at[fit], key[fit]
                if len(key):
                    order = np.argsort(key, kind="stable")
                    seen = np.zeros(1 << _BITS, bool)
                    seen[tx.mix(key) >> U64(64 - _BITS)] = True
                    self.tables.append((mask, key[order], at[order], item[at[order]], seen))

    def hits(self, word: np.ndarray, doc: np.ndarray):
        """Distinct (document, item, diagonal) with an equal seed; the diagonal is the document's word minus the item's."""
        items, low_diagonal = len(self.ids), int(self.count.max(initial=0))
        span = len(word) + low_diagonal + 1
        found = np.zeros(0, I64)
        for mask, keys, at, item, seen in self.tables:
            place, key = _seeds(word, doc, mask)
            maybe = np.flatnonzero(seen[tx.mix(key) >> U64(64 - _BITS)])
            place, key = place[maybe], key[maybe]
            low = np.searchsorted(keys, key, "left")
            many = np.searchsorted(keys, key, "right") - low
            place, low, many = place[many > 0], low[many > 0], many[many > 0]
            total = np.concatenate([[0], np.cumsum(many)])
            for begin in range(0, int(total[-1]), _STEP):
                nth = np.arange(begin, min(begin + _STEP, int(total[-1])))
                row = np.searchsorted(total, nth, "right") - 1
                slot = low[row] + nth - total[row]
                k = item[slot]
                own = (doc[place[row]] * items + k) * span + place[row] - (at[slot] - self.begin[k]) + low_diagonal
                found = np.unique(np.concatenate([found, np.unique(own)]))
        pair, diagonal = found // span, found % span - low_diagonal
        return np.stack([pair // items, pair % items, diagonal], 1) if len(found) else np.zeros((0, 3), I64)

    def stretch(self, word: np.ndarray, low: int, high: int, item: int, diagonal: int):
        """(words, equal words, first word in the item) of the best stretch on a diagonal, or None. low, high: the places of the document's words."""
        size, begin = int(self.count[item]), int(self.begin[item])
        i, j = max(low, diagonal), min(high, diagonal + size)
        same = word[i:j] == self.word[begin + i - diagonal : begin + j - diagonal]
        if size < SHORTEST:
            return (size, size, 0) if high - low == size and same.all() else None
        if len(same) == size and 5 * int(same.sum()) >= 4 * size:
            return size, int(same.sum()), 0
        if size < self.least:
            return None
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])  # not negative between two places: at least 80 %
        best = np.minimum.accumulate(np.where(np.append(same, False), score, len(same) + 1))  # a stretch starts with an equal word
        first = np.searchsorted(-best, -score, "left")  # the earliest place that isn't above
        length = np.arange(len(score)) - first
        length[1:][~same] = 0
        k = int(length.argmax())
        if length[k] < self.least:
            return None
        s = int(first[k])
        return int(length[k]), int(same[s:k].sum()), i - diagonal + s


_OUT = "doc_id long, item_id long, n_words int, n_equal int, item_word int, doc_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, item_word, doc_word): the best common stretch of each document and item that share one."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.toArrow()
        raw, off = tx.utf8(rows.column("text"))
        sent = spark.sparkContext.broadcast((rows.column("item_id").to_numpy(), raw, off))

        def run(batches, sent=sent):
            seeds = Seeds(*sent.value, least)
            for rows, raw, off in tx.pieces(batches):
                start, end, doc = tx.words(raw, off, plain=True)
                word = tx.word_hashes(raw, start, end)
                bound = np.searchsorted(doc, np.arange(len(off)))
                out = []
                for d, item, diagonal in seeds.hits(word, doc).tolist():
                    best = seeds.stretch(word, int(bound[d]), int(bound[d + 1]), item, diagonal)
                    if best:
                        out.append((d, item, *best, diagonal + best[2] - int(bound[d])))
                if out:
                    d, item, n, same, at, where = (np.array(x, I64) for x in zip(*out))
                    ids = rows.column(0).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(seeds.ids[item]), *[pa.array(x.astype(np.int32)) for x in (n, same, at, where)]], ["doc_id", "item_id", "n_words", "n_equal", "item_word", "doc_word"])

        own = docs.mapInArrow(run, _OUT)
        found = own if found is None else found.union(own)
    best = F.max(F.struct("n_words", "n_equal", (-F.col("item_word")).alias("a"), (-F.col("doc_word")).alias("b"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_words", "x.n_equal", (-F.col("x.a")).alias("item_word"), (-F.col("x.b")).alias("doc_word"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that share a stretch of 13 words or more with 80 % of them equal."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
