"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens (marked words, see ``_pieces``) of a piece of work go into a trie. Forward
scores are computed once for each node, that is for each distinct prefix, level by level: the best
score of a prefix is the best over its last pieces of the score of the shorter prefix, an ancestor.
With each best score goes the number of tokens on its path; a pre-token's count is the one stored
at its terminal node. A text's count is the sum over its pre-tokens; nothing is shuffled.

Counts are those of the unigram model in ``_pieces``; unknown characters count their UTF-8 bytes.

Defined cases: null or empty text: 0 tokens. Null or repeated doc_ids and extra columns make no
difference; there is one result row for each input row. Pre-tokens of any length are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import _pieces as pc
from spindrift.llm import _text as tx
from spindrift.llm.lang_id import PieceTable, _codes

U64, I64 = np.uint64, np.int64
_WORK = 4 << 20
LONG = 200


class TrieCounter:
    """Token counts of pre-tokens."""

    def __init__(self, vocab: pc.Vocabulary):
        self.vocab = vocab
        self.table = PieceTable(vocab.pieces)
        self.by_length = [np.zeros(0)] * (vocab.longest + 1)

    def count(self, words: list[str]) -> np.ndarray:
        """Counts of sorted distinct words; tries of bounded size. Words of over LONG characters share no prefix worth a table: their tries are paths."""
        out = np.zeros(len(words), I64)
        sizes = np.array([len(w) for w in words], I64)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._path(words[k])
        for low, high, room in ((1, 24, 40_000), (25, LONG, 4_000)):
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            for at in range(0, len(rows), room):
                part = rows[at : at + room]
                out[part] = self._trie([words[i] for i in part], sizes[part])
        return out

    def _path(self, word: str, step: int = 4000) -> int:
        """The count of one word, place by place; only the scores that a piece can reach back to are held."""
        table, vocab = self.table, self.vocab
        reach, unknown = table.longest, vocab.unknown
        codes = _codes([word], len(word))[0]
        near, tokens = np.full(reach, -np.inf), np.zeros(reach, I64)
        near[-1] = 0.0
        for at in range(0, len(codes), step):
            to = min(len(codes), at + step)
            low = max(0, at - reach)
            prefix = table._prefix(codes[None, low:to])[0]
            score = np.full((to - at, reach), -np.inf)  # of the pieces that end at a place, the longest first
            end = np.arange(at + 1, to + 1)
            for size in range(1, reach + 1):
                rows = np.flatnonzero(end >= size)
                key = prefix[end[rows] - low] - prefix[end[rows] - size - low] * tx.powers(size + 1)[size]
                found = np.flatnonzero(table.seen[key >> U64(44)])
                place = np.minimum(np.searchsorted(table.key, key[found]), table.size - 1)
                hit = table.key[place] == key[found]
                score[rows[found[hit]], reach - size] = vocab.scores[table.number[place[hit]]]
            c = codes[at:to]
            width = (1 + (c > 0x7F).astype(I64) + (c > 0x7FF) + (c > 0xFFFF)).tolist()
            single = (score[:, -1] > -np.inf).tolist()
            best = np.concatenate([near, np.zeros(to - at)])
            count = np.concatenate([tokens, np.zeros(to - at, I64)])
            for k in range(to - at):
                own = best[k : k + reach] + score[k]
                j = int(own.argmax())  # of equal ones the longest piece
                value, n = own[j], count[k + j] + 1
                if not single[k] and best[k + reach - 1] + unknown > value:
                    value, n = best[k + reach - 1] + unknown, count[k + reach - 1] + width[k]
                best[k + reach], count[k + reach] = value, n
            near, tokens = best[-reach:], count[-reach:]
        return int(tokens[-1])

    def _trie(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        m, depth = len(words), int(sizes.max())
        codes = _codes(words, depth)
        differ = np.ones((m, depth), bool)
        differ[1:] = codes[1:] != codes[:-1]
        fresh = np.logical_or.accumulate(differ, axis=1)  # a new prefix from the first difference on
        wide = np.ones(depth, I64)
        prefix = self.table._prefix(codes)
        node = np.zeros(m, I64)  # each word's node on the level
        nodes, score, count = [node], [np.zeros(1)], [np.zeros(1, I64)]
        longest = self.table.longest
        out = np.zeros(m, I64)
        for end in range(1, depth + 1):
            here = sizes >= end
            make = fresh[:, end - 1] & here
            node = np.maximum(np.cumsum(make) - 1, 0)
            rows = np.flatnonzero(make)
            best, tokens = np.full(len(rows), -np.inf), np.zeros(len(rows), I64)
            single = np.zeros(len(rows), bool)
            for start in range(max(0, end - longest), end):  # longer pieces first: they win ties
                key = prefix[rows, end] - prefix[rows, start] * tx.powers(end - start + 1)[end - start]
                hit = np.flatnonzero(self.table.seen[key >> U64(44)])
                if len(hit):
                    at = np.minimum(np.searchsorted(self.table.key, key[hit]), self.table.size - 1)
                    hit, at = hit[self.table.key[at] == key[hit]], at[self.table.key[at] == key[hit]]
                if len(hit):
                    above = nodes[start][rows[hit]]
                    new = score[start][above] + self.vocab.scores[self.table.number[at]]
                    better = new > best[hit]
                    best[hit[better]] = new[better]
                    tokens[hit[better]] = count[start][above[better]] + 1
                    if start == end - 1:
                        single[hit] = True
            above = nodes[end - 1][rows]
            new = score[end - 1][above] + self.vocab.unknown
            unknown = ~single & (new > best)
            c = codes[rows, end - 1]
            width = 1 + (c > 0x7F).astype(I64) + (c > 0x7FF) + (c > 0xFFFF)
            best[unknown], tokens[unknown] = new[unknown], (count[end - 1][above] + width)[unknown]
            nodes.append(node)
            score.append(best)
            count.append(tokens)
            last = np.flatnonzero(sizes == end)
            out[last] = tokens[node[last]]  # terminal counts
            if end >= longest:  # levels out of reach
                nodes[end - longest] = score[end - longest] = count[end - longest] = wide[:0]
        return out


class Counter:
    """Counts texts; remembers up to ``most`` pre-tokens."""

    def __init__(self, vocab: pc.Vocabulary, most: int = 1_000_000):
        self.trie, self.most = TrieCounter(vocab), most
        self.key, self.n = np.zeros(1, U64), np.zeros(1, I64)

    def _counts(self, raw, start, end, marked, key) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        new = np.flatnonzero(self.key[at] != key)
        if not len(new):
            return self.n[at]
        data = raw.tobytes()
        words = sorted(((pc.MARK if marked[i] else "") + data[start[i] : end[i]].decode("utf-8", "surrogatepass").replace(" ", pc.MARK), i) for i in new.tolist())
        found = np.zeros(len(key), I64)
        old = self.key[at] == key
        found[old] = self.n[at[old]]
        found[[i for _, i in words]] = self.trie.count([w for w, _ in words])
        if len(self.key) + len(new) > self.most:
            self.key, self.n = self.key[:0], self.n[:0]
        both = np.concatenate([self.key, key if not len(self.key) else key[new]])
        n = np.concatenate([self.n, found if not len(self.key) else found[new]])
        order = np.argsort(both, kind="stable")
        self.key, self.n = both[order], n[order]
        return found

    def texts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each text; a line feed is a token, not a pre-token."""
        n = len(off) - 1
        start, end, doc, marked = pc.segments(raw, off)
        if not len(start):
            return np.zeros(n, I64), np.zeros(n, I64)
        key = pc.segment_keys(raw, start, end, marked)
        own, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        each = self._counts(raw, start[where], end[where], marked[where], own)[inverse] + ~marked
        return np.bincount(doc, each, n).astype(I64), np.bincount(doc, marked | (end > start), n).astype(I64)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocab: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row with n_tokens and n_pre_tokens of its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(pc.load(vocab or tx.vocabulary_path()))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("n_pre_tokens", T.LongType())])

    def run(batches):
        counter = Counter(sent.value)
        for rows, raw, off in tx.pieces(batches, "__text", _WORK):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *[pa.array(x) for x in counter.texts(raw, off)]], [*keep, "n_tokens", "n_pre_tokens"])

    return source.mapInArrow(run, schema)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, n_pre_tokens."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
