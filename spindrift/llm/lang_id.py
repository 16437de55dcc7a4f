"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability
of a pre-token is the sum over all its segmentations into pieces (forward algorithm), that of a
text the product over its pre-tokens; the language with the largest posterior (equal priors) wins.

Pre-tokens: runs of letters of any length, lower-cased, with the mark U+2581 in front. All
segmentations of a run are summed up however long it is: runs of over ``LONG`` characters go one at a
time, with as many scores held as the longest piece has characters.

Learning: expected piece counts by forward-backward over a bounded sample of labelled rows,
``docs_per_lang`` rows for each language in expectation, picked by a hash of doc_id; in learning alone
a run is cut after each ``LEARNED_RUN`` letters, which bounds a word's tables. Every language
of a labelled row with a letter is learned, each in a task of its own from its bounded sample; texts
are scored in blocks of ``BLOCK`` languages, which bounds what is held besides the model. All texts are scored, each in the partition where it is read: no shuffle, and the model (vocabulary size x
languages doubles) is the only thing that is broadcast.

Defined cases: text null, empty or without a letter -> ``und``, score 0. doc_id null -> not held
out and never learned from. lang null -> not learned from. Nothing learned -> every text ``und``.
Ties go to the language that comes first in code-point order. Repeated rows give repeated results.
Extra columns are ignored by ``predict_languages``'s result unless asked for with ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import _text as tx

U64 = np.uint64
MARK = "▁"
LONG = 64
LEARNED_RUN = 512
UNKNOWN = 1e-9
BLOCK = 64  # languages at a time
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size).astype(U64)


class PieceTable:
    """Piece numbers by a hash of their characters."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        key = np.zeros(self.size, U64)
        for length in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == length]
            key[at] = self._prefix(_codes([pieces[i] for i in at], length))[:, -1]
        order = np.argsort(key)
        self.key, self.number = key[order], order
        assert (np.diff(self.key) > 0).all(), "two pieces share a hash"
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.key >> U64(44)] = True

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes, from the empty one on: h * m + spread(code)."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), U64)
        spread = tx.mix(codes + U64(0x1234567))
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * tx._MULT + spread[:, i]
        return out

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For end after end: (start, end, rows, pieces) of the words whose substring is a piece."""
        prefix = self._prefix(codes)
        for end in range(1, codes.shape[1] + 1):
            for start in range(max(0, end - self.longest), end):
                key = prefix[:, end] - prefix[:, start] * tx.powers(end - start + 1)[end - start]
                rows = np.flatnonzero(self.seen[key >> U64(44)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.key, key[rows]), self.size - 1)
                    hit = self.key[at] == key[rows]
                    rows, at = rows[hit], at[hit]
                yield start, end, rows, self.number[at] if len(rows) else rows


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    probs: np.ndarray  # pieces x langs

    def table(self) -> PieceTable:
        if not hasattr(self, "_table"):
            self._table = PieceTable(self.pieces)
        return self._table

    def blocks(self) -> list[Model]:
        """The model in parts of at most BLOCK languages; they share its memory."""
        if len(self.langs) <= BLOCK:
            return [self]
        parts = [Model(self.langs[k : k + BLOCK], self.pieces, self.probs[:, k : k + BLOCK]) for k in range(0, len(self.langs), BLOCK)]
        for part in parts:
            part._table = self.table()
        return parts

    def log_forward(self, words: list[str]) -> np.ndarray:
        """Natural log of each pre-token's probability in each language."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.array([len(w) for w in words], int)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._long(_codes([words[k]], int(sizes[k]))[0])
        for size in np.unique(sizes[sizes <= LONG]):
            rows = np.flatnonzero(sizes == size)
            most = min(20_000, max(1, 80_000 // max(1, len(self.langs))))
            for at in range(0, len(rows), most):
                part = rows[at : at + most]
                out[part] = self._forward(_codes([words[i] for i in part], int(size)))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        n, size = codes.shape
        alpha = np.zeros((size + 1, n, len(self.langs)))
        alpha[0] = 1
        scale = np.zeros((n, len(self.langs)))
        reach = self.table().longest
        for start, end, rows, piece in self.table().spans(codes):
            if len(rows):
                alpha[end, rows] += alpha[start, rows] * self.probs[piece]
            if start == end - 1:
                alone = np.ones(n, bool)
                alone[rows] = False
                alpha[end, alone] += alpha[start, alone] * UNKNOWN
                if end % 12 == 0 or end == size:  # keeps numbers away from underflow
                    low = max(0, end - reach)
                    top = alpha[low : end + 1].max(0)
                    alpha[low : end + 1] /= top
                    scale += np.log(top)
        return np.log(alpha[size]) + scale


    def _long(self, codes: np.ndarray, step: int = 2000) -> np.ndarray:
        """The forward sum of one word, place by place: only the scores that a piece can reach back to are held."""
        table, langs = self.table(), len(self.langs)
        reach = table.longest
        logs = np.zeros(langs)
        near = np.zeros((reach, langs))  # scores of the last places
        near[-1] = 1
        for at in range(0, len(codes), step):
            to = min(len(codes), at + step)
            low = max(0, at - reach)
            prefix = table._prefix(codes[None, low:to])[0]
            share = np.zeros((to - at, reach, langs))  # of the pieces that end at a place, by where they begin
            end = np.arange(at + 1, to + 1)
            for size in range(1, reach + 1):
                rows = np.flatnonzero(end >= size)
                key = prefix[end[rows] - low] - prefix[end[rows] - size - low] * tx.powers(size + 1)[size]
                found = np.flatnonzero(table.seen[key >> U64(44)])
                place = np.minimum(np.searchsorted(table.key, key[found]), table.size - 1)
                hit = table.key[place] == key[found]
                if size == 1:
                    share[:, -1] = UNKNOWN
                share[rows[found[hit]], reach - size] = self.probs[table.number[place[hit]]]
            score = np.concatenate([near, np.zeros((to - at, langs))])
            for k in range(to - at):
                own = (score[k : k + reach] * share[k]).sum(0)
                score[k + reach] = own
                if k % 8 == 7 or k == to - at - 1:  # keeps numbers away from underflow
                    score[k + 1 : k + reach + 1] /= own
                    logs += np.log(own)
            near = score[-reach:]
        return logs


def _scale(values: np.ndarray, logs: np.ndarray, low: int, high: int, at: int) -> None:
    """Divides the values that are still needed, low to high, by those at a place, and the places not yet reached take the logs over."""
    top = values[at].copy()
    values[low : high + 1] /= top
    logs[low : high + 1] += np.log(top)
    if at == high:
        logs[high + 1 :] = logs[high]
    else:
        logs[:low] = logs[low]


def _expected(table: PieceTable, groups: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under piece probabilities p."""
    out = np.zeros(len(p))
    for codes, weight in groups:
        n, size = codes.shape
        spans = list(table.spans(codes))
        alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
        alpha[0] = beta[size] = 1
        scaled = size > 24  # shorter words can't underflow
        up, down = (np.zeros((size + 1, n)), np.zeros((size + 1, n))) if scaled else (None, None)  # logs of what alpha, beta were divided by
        for start, end, rows, piece in spans:
            alpha[end, rows] += alpha[start, rows] * p[piece]
            if start == end - 1:
                alone = np.setdiff1d(np.arange(n), rows)
                alpha[end, alone] += alpha[start, alone] * UNKNOWN
                if scaled:
                    _scale(alpha, up, max(0, end - table.longest), end, end)
        last = size
        for start, end, rows, piece in sorted(spans, key=lambda x: -x[0]):
            if scaled and start < last < size:  # beta at last is whole
                _scale(beta, down, last, min(size, last + table.longest), last)
            last = start
            beta[start, rows] += p[piece] * beta[end, rows]
            if start == end - 1:
                alone = np.setdiff1d(np.arange(n), rows)
                beta[start, alone] += UNKNOWN * beta[end, alone]
        total = np.maximum(alpha[size], 1e-300)
        for start, end, rows, piece in spans:
            if len(rows):
                share = weight[rows] * alpha[start, rows] * p[piece] * beta[end, rows] / total[rows]
                out += np.bincount(piece, share * np.exp(up[start, rows] + down[end, rows] - up[size, rows]) if scaled else share, len(p))
    return out


def pre_tokens(text: str, most: int = 0) -> list[str]:
    """Marked, lower-cased runs of letters; cut after every ``most`` letters if that isn't 0."""
    found = []
    for run in _LETTERS.findall(text.lower()):
        found += [MARK + run[i : i + most] for i in range(0, len(run), most)] if most and len(run) > most else [MARK + run]
    return found


def fit_one(words: dict[str, int], table: PieceTable, rounds: int = 4, smoothing: float = 0.01) -> np.ndarray:
    """Piece probabilities of one language from counts of its pre-tokens."""
    groups = []
    names = sorted(words)
    for size in sorted({len(w) for w in names}):
        own = [w for w in names if len(w) == size]
        most = 20_000 if size <= 24 else max(1, 320_000 // size)  # as much memory as for the longest of the others
        for at in range(0, len(own), most):
            part = own[at : at + most]
            groups.append((_codes(part, size), np.array([words[w] for w in part], float)))
    p = np.full(table.size, 1 / table.size)
    for _ in range(rounds):
        n = _expected(table, groups, p) + smoothing
        p = n / n.sum()
    return p


def fit(counts: Iterable[tuple[str, str, int]], pieces: list[str], rounds: int = 4, smoothing: float = 0.01) -> Model:
    """Learn from (lang, pre-token, count)."""
    by: dict[str, dict[str, int]] = {}
    for lang, word, n in counts:
        by.setdefault(lang, {})[word] = n
    table = PieceTable(pieces)
    langs = sorted(by)
    model = Model(langs, pieces, np.stack([fit_one(by[x], table, rounds, smoothing) for x in langs], 1) if langs else np.zeros((len(pieces), 0)))
    model._table = table
    return model


def learn(labelled: DataFrame, docs_per_lang: int = 400, vocab: str | None = None, seed: int = 7) -> Model:
    """Fit on a bounded sample of (doc_id, text, lang): docs_per_lang rows of each language."""
    named = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    totals = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    pieces = vocabulary(vocab or tx.vocabulary_path())
    if not totals:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    space = 1 << 62
    kind = T.StructType([T.StructField("lang", named.schema["lang"].dataType), T.StructField("__bound", T.LongType())])
    bound = labelled.sparkSession.createDataFrame([(lang, min(space, space * docs_per_lang // n)) for lang, n in totals.items()], kind)
    picked = named.select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(space)).alias("__at"))
    sample = picked.join(F.broadcast(bound), "lang").where("__at < __bound").select("lang", "text")

    def count(batches):
        for batch in batches:
            n: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in pre_tokens(text or "", LEARNED_RUN):
                    n[lang, word] = n.get((lang, word), 0) + 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    found = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sent = labelled.sparkSession.sparkContext.broadcast(pieces)

    def one(key, words):
        got = words.to_pydict()
        p = fit_one(dict(zip(got["word"], got["n"])), PieceTable(sent.value))
        return pa.table({"lang": [key[0].as_py()], "p": pa.array([p.tobytes()], pa.binary())})

    rows = sorted(found.groupBy("lang").applyInArrow(one, "lang string, p binary").collect())
    return Model([r["lang"] for r in rows], pieces, np.stack([np.frombuffer(bytes(r["p"])) for r in rows], 1) if rows else np.zeros((len(pieces), 0)))


class _Words:
    """Scores words in the languages of a block; remembers up to ``most`` of those seen before."""

    def __init__(self, model: Model, most: int):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, U64)
        self.score = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, np.int32)

    def lookup(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of letters for distinct, sorted keys."""
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        new = np.flatnonzero(self.key[at] != key) if len(self.key) else np.arange(len(key))
        if len(new):
            data = raw.tobytes()
            index: dict[str, int] = {}
            owner, word, letters = [], [], np.zeros(len(new), np.int32)
            for i, (s, e) in enumerate(zip(start[new].tolist(), end[new].tolist())):
                for run in pre_tokens(data[s:e].decode("utf-8", "replace")):
                    owner.append(i)
                    word.append(index.setdefault(run, len(index)))
                    letters[i] += len(run) - 1
            each = self.model.log_forward(list(index))
            owner, word = np.array(owner, int), np.array(word, int)
            score = np.stack([np.bincount(owner, each[word, k], len(new)) if len(owner) else np.zeros(len(new)) for k in range(each.shape[1])], 1)
            if len(self.key) + len(new) > self.most:
                self.key, self.score, self.letters = key[:0], self.score[:0], self.letters[:0]
                if len(new) < len(key):
                    return self.lookup(raw, start, end, key)
            order = np.argsort(np.concatenate([self.key, key[new]]), kind="stable")
            self.key = np.concatenate([self.key, key[new]])[order]
            self.score = np.concatenate([self.score, score])[order]
            self.letters = np.concatenate([self.letters, letters])[order]
            at = np.searchsorted(self.key, key)
        return self.score[at], self.letters[at]


class Scorer:
    """Scores pieces of work; remembers the scores of words seen before, up to ``most`` of them, or as many fewer as there are more than BLOCK languages."""

    def __init__(self, model: Model, most: int = 300_000):
        self.langs = model.langs
        blocks = model.blocks()
        self.blocks = [_Words(block, most // len(blocks)) for block in blocks]

    def texts(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, langs = len(off) - 1, self.langs
        if not langs:
            return ["und"] * n, np.zeros(n)
        start, end, doc = tx.words(raw, off)
        key, first, inverse = np.unique(tx.word_hashes(raw, start, end), return_index=True, return_inverse=True)
        total, letters = np.zeros((n, len(langs))), np.zeros(0, int)
        for b, block in enumerate(self.blocks if len(key) else []):
            score, letters = block.lookup(raw, start[first], end[first], key)
            for k in range(score.shape[1]):
                total[:, b * BLOCK + k] = np.bincount(doc, score[inverse, k], n)
        some = np.bincount(doc, letters[inverse], n) > 0 if len(doc) else np.zeros(n, bool)
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        share = share.max(1) / share.sum(1)
        return [langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, share, 0.0)


def predict_languages(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of each row, with language and score of the whole text as ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))
    keep = list(dict.fromkeys(keep))
    plain = [f"c{k}" for k in range(len(keep))]  # any name may come, and mapInArrow takes dots in names for fields
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain)], F.col("text").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(Model(*sent.value))
        for rows, raw, off in tx.pieces(batches):
            lang, score = scorer.texts(raw, off)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*plain, "lang", "score"])

    return source.mapInArrow(run, schema).toDF(*keep, *names)


def held_out(doc_id) -> F.Column:
    """True where crc32 of doc_id's text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict_languages(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
