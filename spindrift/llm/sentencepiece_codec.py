"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a piece of work are sorted, which lays them out as a trie in
depth-first order: a word shares its first characters with the one before it. The traversal keeps,
for each depth, the best score, the piece that ends there and the places in the vocabulary's trie
that are still open, and goes on from the depth up to which the two words agree; the forward scores
of a common prefix are computed once. Known words are looked up, and texts are put together from
their words' ids with array operations. Texts aren't shuffled.

See ``_pieces`` for the model. The vocabulary file at hand is one of a merge (BPE) model, whose
scores are ranks; this operator finds the best path by those scores, as a unigram model does, and
doesn't replay merges, so ids differ from the merge algorithm's for some words. Decoding gives the
text back either way.

Defined cases: null text: ids null, n_tokens 0. Empty text: no ids. A text that holds U+2581 itself
decodes to a space there, as the format can't tell them apart: ``exact`` is false. Null or repeated
doc_ids and extra columns make no difference; there is one result row for each input row.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import _pieces as pc
from spindrift.llm import _text as tx

U64, I64 = np.uint64, np.int64
_WORK = 4 << 20


class Viterbi:
    """Best paths of words, with a trie of the vocabulary: node -> {character: (child, piece number or -1)}."""

    def __init__(self, vocab: pc.Vocabulary):
        self.vocab = vocab
        self.trie: list[dict] = [{}]
        for k, piece in enumerate(vocab.pieces):
            node = 0
            for i, c in enumerate(piece):
                child, own = self.trie[node].get(c, (0, -1))
                if not child:
                    self.trie.append({})
                    child = len(self.trie) - 1
                self.trie[node][c] = (child, k if i == len(piece) - 1 else own)
                node = child
        self.scores = vocab.scores.tolist()
        self.ids = vocab.ids.tolist()
        self.lengths = [len(p) for p in vocab.pieces]

    def encode_sorted(self, words: list[str]):
        """The ids of each of the sorted words."""
        trie, scores, unknown = self.trie, self.scores, self.vocab.unknown
        best: list[float] = [0.0]
        piece: list[int] = [-1]
        open_: list[list] = [[]]
        last = ""
        for word in words:
            depth = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], piece[depth + 1 :], open_[depth + 1 :]
            for at in range(depth, len(word)):
                c = word[at]
                top, own, going, single = -1e30, -1, [], False
                for start, node in open_[at]:  # earlier starts first: the longer piece wins ties
                    found = trie[node].get(c)
                    if found:
                        child, k = found
                        if k >= 0:
                            score = best[start] + scores[k]
                            if score > top:
                                top, own = score, k
                        if trie[child]:
                            going.append((start, child))
                found = trie[0].get(c)
                if found:
                    child, k = found
                    if k >= 0:
                        single = True
                        score = best[at] + scores[k]
                        if score > top:
                            top, own = score, k
                    if trie[child]:
                        going.append((at, child))
                if not single and best[at] + unknown > top:
                    top, own = best[at] + unknown, -1
                best.append(top)
                piece.append(own)
                open_.append(going)
            last = word
            yield self._path(word, piece)

    def _path(self, word: str, piece: list[int]) -> list[int]:
        out: list[int] = []
        at = len(word)
        while at:
            k = piece[at]
            if k < 0:  # an unknown
                out += [int(self.vocab.bytes_[b]) for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                out.append(self.ids[k])
                at -= self.lengths[k]
        out.reverse()
        return out


class Codec:
    """Encodes and decodes pieces of work; remembers up to ``most`` words."""

    def __init__(self, vocab: pc.Vocabulary, most: int = 400_000):
        self.vocab, self.most = vocab, most
        self.viterbi = Viterbi(vocab)
        self.feed = int(vocab.bytes_[0x0A])
        surface = [s for s in vocab.surface]
        self.size = np.array([len(s) for s in surface], I64)
        self.place = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self._reset()

    def _reset(self):
        self.known: dict[int, int] = {0: 0}
        self.ids = array("i")
        self.first = array("q", [0])
        self.count = array("i", [0])

    def _learn(self, raw: np.ndarray, start, end, marked, key) -> np.ndarray:
        """Slots of distinct segments."""
        new = [i for i, k in enumerate(key.tolist()) if k not in self.known]
        if len(self.known) + len(new) > self.most and len(self.known) > 1:
            self._reset()
            new = [i for i, k in enumerate(key.tolist()) if k]
        if new:
            data = raw.tobytes()
            words = sorted(((pc.MARK if marked[i] else "") + data[start[i] : end[i]].decode("utf-8", "surrogatepass").replace(" ", pc.MARK), i) for i in new)
            for (_, i), ids in zip(words, self.viterbi.encode_sorted([w for w, _ in words])):
                self.known[int(key[i])] = len(self.first)
                self.first.append(len(self.ids))
                self.count.append(len(ids))
                self.ids.extend(ids)
        return np.fromiter((self.known[k] for k in key.tolist()), I64, len(key))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each)."""
        n = len(off) - 1
        start, end, doc, marked = pc.segments(raw, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n, I64)
        key = pc.segment_keys(raw, start, end, marked)
        own, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot = self._learn(raw, start[where], end[where], marked[where], own)[inverse]
        first, count = np.frombuffer(self.first, I64)[slot], np.frombuffer(self.count, np.int32)[slot].astype(I64)
        feed = (~marked).astype(I64)
        total = count + feed
        out = np.full(int(total.sum()), self.feed, np.int32)
        at = np.cumsum(total) - total + feed
        row = np.repeat(np.arange(len(slot)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        if len(row):
            out[at[row] + inside] = np.frombuffer(self.ids, np.int32)[first[row] + inside]
        return out, np.bincount(doc, total, n).astype(I64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets): the pieces' surfaces, less the first mark of each text."""
        size = self.size[ids]
        row = np.repeat(np.arange(len(ids)), size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        raw = self.flat[self.place[ids][row] + inside]
        doc = np.repeat(np.arange(len(count)), count)
        width = np.bincount(doc, size, len(count)).astype(I64)
        off = np.concatenate([[0], np.cumsum(width)])
        some = np.flatnonzero(width > 0)
        keep = np.ones(len(raw), bool)
        keep[off[some]] = raw[off[some]] != 0x20
        width[some] -= ~keep[off[some]]
        return raw[keep], np.concatenate([[0], np.cumsum(width)])


def encode(docs: DataFrame, keep: list[str], text: str = "text", vocab: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row with n_tokens, ids and exact (decoding the ids gives the text back)."""
    path = vocab or tx.vocabulary_path()
    sent = docs.sparkSession.sparkContext.broadcast(pc.load(path))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])

    def run(batches):
        codec = Codec(sent.value)
        for rows, raw, off in tx.pieces(batches, "__text", _WORK):
            ids, count = codec.encode(raw, off)
            back, at = codec.decode(ids, count)
            if np.array_equal(at, off):
                wrong = np.add.reduceat(np.append(back != raw, False), np.minimum(off[:-1], len(raw)), dtype=I64) > 0
                exact = ~wrong | (np.diff(off) == 0)
            else:
                exact = np.array([back[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], off[:-1], off[1:])])
            null = rows.column(rows.num_columns - 1).is_null()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids))
            if null.true_count:
                lists = pa.compute.if_else(null, pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(count), lists, pa.array(exact)], [*keep, "n_tokens", "ids", "exact"])

    return source.mapInArrow(run, schema)


def decode(frame: DataFrame, keep: list[str], ids: str = "ids", vocab: str | None = None) -> DataFrame:
    """The columns ``keep`` with the text of the ids; null ids give a null text, bytes that aren't UTF-8 U+FFFD."""
    sent = frame.sparkSession.sparkContext.broadcast(pc.load(vocab or tx.vocabulary_path()))
    source = frame.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec(sent.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            count = pa.compute.list_value_length(lists).fill_null(0).to_numpy().astype(I64)
            raw, off = codec.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(I64), count)
            text = [None if gone else raw[a:b].tobytes().decode("utf-8", "replace") for gone, a, b in zip(lists.is_null().to_pylist(), off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], [*keep, "text"])

    return source.mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, exact."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
