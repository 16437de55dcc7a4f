"""Language ID, token counts, SentencePiece, licences, HTML, WARC and nearest neighbours."""
import base64
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import _pieces as pc
from spindrift.llm import _text as tx
from spindrift.llm import ann, html_extract, lang_id, licenses, sentencepiece_codec, token_counts, warc
from tests.llm import helpers as h


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    tx.prepare(spark)


@pytest.fixture(scope="module")
def vocab():
    return pc.load(tx.vocabulary_path())


ODD = ["", " ", "  a", "a  b   c ", "\n", "\n\n x\n", "ß漢字 🙂\t", "1.5,2", "Zürich\nöl", "x" * 300, "the " * 50]


def best_path(vocab, text):
    """Quadratic Viterbi over a whole text."""
    score = {p: (s, i) for p, s, i in zip(vocab.pieces, vocab.scores, vocab.ids)}
    text = (pc.MARK + text.replace(" ", pc.MARK)) if text else ""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(max(0, end - vocab.longest), end):
            found = score.get(text[start:end])
            if found and (top is None or best[start][0] + found[0] > top[0]):
                top = best[start][0] + found[0], [*best[start][1], int(found[1])]
        if text[end - 1] not in score and (top is None or best[end - 1][0] + vocab.unknown > top[0]):
            top = best[end - 1][0] + vocab.unknown, best[end - 1][1] + [int(vocab.bytes_[b]) for b in text[end - 1].encode()]
        best.append(top)
    return best[-1][1]


def test_codec_is_the_best_path(spark, vocab):
    rng = random.Random(3)
    texts = ODD + [h.sentence(rng, 12, "etaonish") for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (1000, None)]
    got = {(r.doc_id, r.n_tokens, None if r.ids is None else tuple(r.ids), r.exact) for r in sentencepiece_codec.encode(h.frame(spark, rows), ["doc_id"]).collect()}
    want = {(i, len(b := best_path(vocab, t)), tuple(b), True) for i, t in rows if t is not None}
    assert got == want | {(1000, 0, None, True)}


def test_decode(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    coded = sentencepiece_codec.encode(h.frame(spark, rows), ["doc_id"])
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, ["doc_id"]).collect()} == dict(rows)


def test_codec_forgets_and_is_right(vocab):
    raw, off = tx.utf8(pa.array([h.sentence(random.Random(k), 40) for k in range(20)]))
    small, large = sentencepiece_codec.Codec(vocab, most=50), sentencepiece_codec.Codec(vocab)
    parts = [small.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(off[:-1], off[1:])]
    assert np.array_equal(np.concatenate(parts), large.encode(raw, off)[0])


def test_mark_in_text_is_not_exact(spark):
    got = sentencepiece_codec.encode(h.frame(spark, [(1, "a▁b"), (2, "a b")]), ["doc_id"]).collect()
    assert {r.doc_id: r.exact for r in got} == {1: False, 2: True}


def test_counts_equal_the_codec(spark, vocab):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD + [h.sentence(rng, 30, "etaonishäé") for _ in range(40)] + ["y" * 30000, "".join(rng.choices("etaonishäé漢", k=9000)), "aé" * 150])] + [(None, None)]
    frame = h.frame(spark, rows).withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, ["doc_id"]).collect()}
    assert got == {r.doc_id: r.n_tokens for r in sentencepiece_codec.encode(h.frame(spark, rows), ["doc_id"]).collect()}


def test_counts_by_brute_force(vocab):
    rng = random.Random(8)
    counter = token_counts.TrieCounter(vocab)
    words = sorted({pc.MARK + "".join(rng.choices("etaonishäé漢​", k=rng.choice([1, 3, 9, 30, 150, 260]))) for _ in range(150)})
    plain = [len(best_path(vocab, w[1:])) for w in words]
    assert counter.count(words).tolist() == plain
    assert [counter._path(w, 7) for w in words] == plain


def test_empty_tables(spark):
    docs = h.frame(spark, [])
    assert token_counts.count_tokens(docs, ["doc_id"]).collect() == [] and sentencepiece_codec.encode(docs, ["doc_id"]).collect() == []
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).collect() == []
    model = lang_id.fit([("x", pc.MARK + "a", 1)], [pc.MARK, "a"])
    assert lang_id.predict_languages(docs, model, ["doc_id"]).collect() == []


def test_clashing_columns_of_the_codec(spark):
    rows = [(1, "the text"), (1, "the text"), (None, None)]
    frame = h.frame(spark, rows)
    for c in ("ids", "n_tokens", "exact", "__text", "n_pre_tokens", "a.b"):
        frame = frame.withColumn(c, F.lit("x"))
    got = sentencepiece_codec.encode(frame, ["doc_id"]).collect()
    assert len(got) == 3 and got == sentencepiece_codec.encode(h.frame(spark, rows), ["doc_id"]).collect()
    assert token_counts.count_tokens(frame, ["doc_id"]).count() == 3


def test_forward_sums_all_segmentations():
    pieces = [pc.MARK, "a", "b", "ab", pc.MARK + "a", "ba", "aba"]
    probs = np.random.default_rng(0).random((len(pieces), 2)) / 5
    model = lang_id.Model(["x", "y"], pieces, probs)

    def total(word, k):
        if not word:
            return 1.0
        out = sum(probs[i, k] * total(word[len(p) :], k) for i, p in enumerate(pieces) if word.startswith(p))
        return out + (0 if word[0] in pieces else lang_id.UNKNOWN * total(word[1:], k))

    words = [pc.MARK + w for w in ("a", "abab", "bac", "abaabba" * 3)]
    for word, row in zip(words, model.log_forward(words)):
        assert np.allclose(row, [np.log(total(word, k)) for k in range(2)])
    assert np.allclose(model.log_forward([pc.MARK + "z" * 40])[0], np.log(probs[0]) + 40 * np.log(lang_id.UNKNOWN))  # no letter is a piece


def _log_total(pieces, p, word):
    """The exact sum over all segmentations, with fractions."""
    score = [Fraction(1)]
    for end in range(1, len(word) + 1):
        parts = [score[end - len(x)] * Fraction(q) for x, q in zip(pieces, p) if word[:end].endswith(x) and len(x) <= end]
        score.append(sum(parts) + (0 if word[end - 1] in pieces else score[end - 1] * Fraction(lang_id.UNKNOWN)))
    top = score[-1]
    shift = max(0, top.denominator.bit_length() - top.numerator.bit_length())
    return float(np.log(float(top * 2**shift)) - shift * np.log(2))


@pytest.mark.parametrize("size", [63, 64, 65, 200, 333])
def test_forward_of_long_runs(size):
    pieces = [pc.MARK, "a", "b", "ab", pc.MARK + "a", "ba", "aba", "bbbb"]
    probs = np.random.default_rng(1).random((len(pieces), 2)) / 7
    model = lang_id.Model(["x", "y"], pieces, probs)
    word = pc.MARK + "".join(random.Random(size).choices("aabbz", k=size))
    want = [_log_total(pieces, probs[:, k], word) for k in range(2)]
    assert np.allclose(model.log_forward([word])[0], want) and np.allclose(model._long(lang_id._codes([word], len(word))[0], 7), want)


def test_text_scores():
    """A text's score is the product over its pre-tokens; equal scores go to the first language."""
    pieces = [pc.MARK, "a", "b", "ab", pc.MARK + "a", "ba"]
    probs = np.random.default_rng(2).random((len(pieces), 3)) / 4
    probs[:, 2] = probs[:, 0]
    model = lang_id.Model(["x", "y", "z"], pieces, probs)
    texts = ["ab ba", "Abba, b1a AB", "", "12", "a" * 500 + " b", None]
    langs, scores = lang_id.Scorer(model).texts(*tx.utf8(pa.array(texts)))
    for text, lang, score in zip(texts, langs, scores):
        words = lang_id.pre_tokens(text or "")
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.array([sum(_log_total(pieces, probs[:, k], w) for w in words) for k in range(3)])
        share = np.exp(total - total.max())
        assert lang == ("x" if total[0] >= total[1] else "y") and abs(score - share.max() / share.sum()) < 1e-9


def test_learning_is_expectation_maximisation():
    """One round against expected counts summed over all segmentations one by one."""
    pieces = [pc.MARK, "a", "b", "ab", pc.MARK + "a", "ba"]
    words = {pc.MARK + "abab": 3, pc.MARK + "ba": 2, pc.MARK + "aab": 1}

    def ways(word):
        if not word:
            return [[]]
        return [[k, *rest] for k, x in enumerate(pieces) if word.startswith(x) for rest in ways(word[len(x) :])]

    p = np.full(len(pieces), 1 / len(pieces))
    for _ in range(2):
        n = np.full(len(pieces), 0.01)
        for word, times in words.items():
            each = [(np.prod(p[w]), w) for w in ways(word)]
            for share, w in each:
                for k in w:
                    n[k] += times * share / sum(x for x, _ in each)
        p = n / n.sum()
    assert np.allclose(lang_id.fit([("x", w, n) for w, n in words.items()], pieces, rounds=2).probs[:, 0], p)


def test_long_runs_are_learned():
    pieces = [pc.MARK, "a", "b", "ab", pc.MARK + "a", "ba", "aba"]
    table = lang_id.PieceTable(pieces)
    p = np.random.default_rng(0).random(len(pieces)) * 1e-12  # underflows in 64 letters
    for word in ("ab" * 9 + "zabba" * 4, "aba" * 21 + "b", "z" * 64):
        word = pc.MARK + word
        size = len(word)

        def total(start, end, memo):  # of the segmentations of a part, scaled by 1e12 a letter
            if start == end:
                return 1
            if start not in memo:
                parts = [(len(x), q) for x, q in zip(pieces, p) if word.startswith(x, start) and start + len(x) <= end]
                memo[start] = sum(Fraction(q) * 10 ** (12 * k) * total(start + k, end, memo) for k, q in parts)
                if word[start] not in pieces:
                    memo[start] += Fraction(lang_id.UNKNOWN) * 10**12 * total(start + 1, end, memo)
            return memo[start]

        ahead: dict = {}
        whole = total(0, size, ahead)
        want = [float(sum(total(0, i, {}) * Fraction(q) * 10 ** (12 * len(x)) * total(i + len(x), size, ahead) for i in range(size) if word.startswith(x, i)) / whole) for x, q in zip(pieces, p)]
        got = lang_id._expected(table, [(lang_id._codes([word, word], size), np.array([1.0, 2.0]))], p)
        assert np.allclose(got, 3 * np.array(want))
    model = lang_id.fit([("x", pc.MARK + "ab" * 30, 5), ("y", pc.MARK + "ba" * 10, 5)], pieces)
    assert model.langs == ["x", "y"] and not np.allclose(model.probs[:, 0], 1 / len(pieces))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_id.learn(docs.where(~lang_id.held_out(F.col("doc_id"))))
    rows = lang_id.predict_languages(docs.withColumn("h", lang_id.held_out(F.col("doc_id"))), model, ["doc_id", "lang", "h"]).collect()
    test = [r for r in rows if r.h]
    assert len(test) > 20 and sum(r.lang == r.lang_pred for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = [(1, None), (2, ""), (3, "123 ... !!"), (None, "the of and"), (2, ""), (4, "x" * 100_000)]
    got = sorted(((r.doc_id, r.lang_pred) for r in lang_id.predict_languages(h.frame(spark, odd).withColumn("score", F.lit(1)), model, ["doc_id"]).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (2, "und"), (3, "und")]
    assert (None, "en") in got and len(got) == 6
    none = lang_id.learn(docs.limit(0))
    assert {r.lang_pred for r in lang_id.predict_languages(docs, none, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for k in range(150):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)]
        for _ in range(2 if k else 4):
            rows.append((n, " ".join(rng.choices(words, k=40)), f"l{k:03d}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(docs)
    assert model.langs == sorted({r[2] for r in rows})
    got = lang_id.predict_languages(docs, model, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


def test_licences(spark):
    lines = {
        1: ("Released under the MIT License.", "MIT"), 2: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        4: ("Licensed under the Apache License, Version 2.0.", "Apache"), 5: ("The license plate was new.", None), 6: ("Plain text about nothing.", None), 7: (None, None), 8: ("", None),
        9: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "BSD"),
    }
    rows = [(i, t if t is None else f"Some line.\n\n{t}\nMore text.") for i, (t, _) in lines.items()]
    got = licenses.scan(h.frame(spark, rows)).collect()
    assert {r.doc_id: (r.family, r.confirmed, r.paragraph) for r in got} == {i: (f, True, 1) for i, (_, f) in lines.items() if f}
    whole = {i: t if i != 9 else f"{t}\nMore text." for i, (t, _) in lines.items()}  # 9 goes on in the next line
    assert all(r.text[r.start : r.end] == whole[r.doc_id] for r in licenses.scan(h.frame(spark, rows)).join(h.frame(spark, rows).select("doc_id", "text"), "doc_id").collect())
    assert licenses.scan(h.frame(spark, [])).collect() == []


MIT_GRANT = licenses.GRANTS["MIT"][0]


def test_licences_in_wrapped_lines(spark):
    def wrapped(text, width):
        out = [""]
        for w in text.split():
            if len(out[-1]) + len(w) >= width and out[-1]:
                out.append("")
            out[-1] = f"{out[-1]} {w}".strip()
        return "\n".join(out)

    texts = {1: wrapped(MIT_GRANT, 40), 2: wrapped(MIT_GRANT, 24), 3: "\t\n  " + wrapped(MIT_GRANT, 70).replace("\n", "  \n   "), 4: "x" * 200_000 + ".\n" + wrapped(MIT_GRANT, 40)}
    frame = h.frame(spark, [(i, f"Title.\n\n{t}\n\nEnd.") for i, t in texts.items()] + [(5, "z " * 300_000)]).withColumn("family", F.lit("x")).withColumn("start", F.lit(1))
    got = licenses.scan(frame).collect()
    assert {(r.doc_id, r.family, r.confirmed) for r in got} == {(i, "MIT", True) for i in texts}
    assert {r.doc_id: r.end - r.start for r in got}[1] == len(texts[1])


def test_licences_of_repeated_and_null_ids(spark):
    mit = "Released under the MIT License."
    rows = [(1, mit), (1, mit), (1, "Licensed under CC BY-NC 4.0."), (None, mit), (None, None), (2, None)]
    got = sorted(((r.doc_id, r.family, r.paragraph) for r in licenses.scan(h.frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", 0), (1, "MIT", 0), (1, "CC-BY-NC", 0), (None, "MIT", 0)], key=str)


def test_licence_ties():
    """Equal families: the first in alphabetical order; equal to unknown: unknown."""
    key = np.array([5, 9], np.uint64)
    model = licenses.Classifier([licenses.UNKNOWN, "A", "B"], key, np.array([[0.0, 1, 1], [0, 0, 0]]), np.zeros(3))
    p = model.probabilities(model.logits(np.array([0, 1]), key, 2))
    assert p.argmax(1).tolist() == [1, 0]


def test_other_licences_and_names_are_unknown(spark):
    lines = ["the ISC meeting was held", "Eclipse Public License 2.0", "Released under the Eclipse Public License 2.0.", "He studied at MIT.", "Released under the Foobar License 2.0.", "The Apache helicopter landed."]
    assert licenses.scan(h.frame(spark, list(enumerate(lines)))).collect() == []


def test_licence_paragraphs():
    texts = ["a\nb.\nc\n\nd,\ne*\nf", "", " \n\t\n", "x" * 121 + "\ny", "é\nz", None]
    raw, off = tx.utf8(pa.array(texts))
    data = raw.tobytes()
    got = [(int(d), data[s:e].decode()) for s, e, d in zip(*licenses._paragraphs(raw, off))]
    assert got == [(0, "a\nb."), (0, "c"), (0, "d,\ne*"), (0, "f"), (3, "x" * 121), (3, "y"), (4, "é\nz")]


def test_licence_regression_by_brute_force():
    """Products, probabilities and the gradient against dense arithmetic and differences of the loss."""
    rng = np.random.default_rng(4)
    row, column = rng.integers(0, 12, 60), rng.integers(0, 9, 60)
    x = licenses.Grams(row, column, 12, 9)
    dense = np.zeros((12, 9))
    dense[row, column] = 1
    w, b, y, weight = rng.normal(size=(9, 4)), rng.normal(size=4), rng.integers(0, 4, 12), rng.random(12)
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.transposed_times(rng.normal(size=(12, 4)) * 0 + 1), dense.T @ np.ones((12, 4)))

    def loss(w, b):
        z = dense @ w + b
        return -(weight * (z[np.arange(12), y] - np.log(np.exp(z).sum(1)))).sum() + 0.05 * (w * w).sum()

    value, by_w, by_b = licenses.loss_and_gradient(x, w, b, y, weight, 0.1)
    assert np.isclose(value, loss(w, b))
    e = 1e-6
    for i in range(9):
        for k in range(4):
            d = np.zeros_like(w)
            d[i, k] = e
            assert np.isclose((loss(w + d, b) - loss(w - d, b)) / (2 * e), by_w[i, k], atol=1e-6)
    for k in range(4):
        d = np.zeros(4)
        d[k] = e
        assert np.isclose((loss(w, b + d) - loss(w, b - d)) / (2 * e), by_b[k], atol=1e-6)
    key = np.sort(rng.integers(1, 2**60, 9).astype(np.uint64))
    model = licenses.Classifier(list("abcd"), key, w, b, temperature=1.7)
    p = model.probabilities(model.logits(row, key[column], 12))
    z = np.exp((dense @ w + b) / 1.7)
    assert np.allclose(p, z / z.sum(1, keepdims=True))


def test_licence_scan_by_brute_force(spark):
    """Every paragraph of the documents, one by one, through dense arithmetic on the same trained model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = [x for r in docs.select("text").limit(30).collect() for x in (r.text or "").split("\n")[:10] if x and not licenses._ABOUT.search(x)]
    model = licenses.train(lines)
    frame = docs.select("doc_id", "text")
    got = {(r.doc_id, r.start): (r.family, round(r.probability, 9), r.confirmed) for r in licenses.scan(frame, model=model).collect()}
    weight = dict(zip(model.key.tolist(), model.weight))
    want = {}
    for r in frame.collect():
        raw, off = tx.utf8(pa.array([r.text]))
        for s, e, _ in zip(*licenses._paragraphs(raw, off)):
            _, keys = licenses._features(raw[s:e], np.array([0, e - s]))
            z = model.bias + sum((weight[k] for k in set(keys.tolist()) if k in weight), np.zeros(len(model.families)))
            p = np.exp((z - z.max()) / model.temperature)
            p /= p.sum()
            k = int(p.argmax())
            if k and p[k] >= model.threshold:
                pairs = set(licenses._pairs(raw[s:e].tobytes().decode()).tolist())
                share = max(len(pairs & set(t.tolist())) / len(t) for t in model.pairs[model.families[k]])
                want[r.doc_id, int(s)] = (model.families[k], round(float(p[k]), 9), share >= 0.6)
    assert got == want and want


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><div id="content"><h1>A &amp; B</h1><p>First   paragraph with <a href=x>a link</a> and <b>bold<br>text.<p>Second paragraph, long enough to count as text.
<form><input name=q>Search</form><script>var t="</p>";</script><ul><li>One<li>Two &euro;</ul><div class="comments"><p>Nice post, thanks a lot for writing all of this!</p></div></div>
<aside>Aside</aside><!-- <p>hidden</p> --><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "A & B\n\nFirst paragraph with a link and bold text.\n\nSecond paragraph, long enough to count as text.\n\nOne\n\nTwo €"
    article = "<body><nav>menu</nav><article><h1>Title</h1><p>" + "word " * 200 + "</p><p>x</p></article>"
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just text &lt;b&gt;"), (5, "u", article), (5, "u", article), (None, "u", "<p>a<p>b</"), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<"), (9, "u", "<p>a < b & c</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(frame, ["page_id", "url"]).collect()
    by = {r.page_id: r.text for r in got}
    assert by[1] == want and by[2] == "" and by[3] == "" and by[4] == "just text <b>" and by[None] == "a\n\nb</" and by[7] == "deep" and by[8] == "<" and by[9] == "a < b & c"
    assert by[5] == "Title\n\n" + " ".join(["word"] * 200) + "\n\nx"
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)


def test_html_structures():
    long = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod. " * 3
    text = " ".join(long.split())
    assert html_extract.main_text(f"<article><h1>T</h1><p>{long}</p><div id='comments'><article class='comment'><p>{long}</p></article></div></article>") == f"T\n\n{text}"
    assert html_extract.main_text(f"<article><p>{long}</article><section class='comments'><article><p>{long}</article></section>") == text
    assert html_extract.main_text(f"<div id=wrap><div class=menu><a href=1>x</a></div><div><h2>T</h2><div><p>{long}<p>{long}</div><div>short</div></div><div class=sidebar>{long}</div></div>") == f"T\n\n{text}\n\n{text}\n\nshort"
    assert html_extract.main_text(f"<div class='page-menu x'><article><p>{long}</article></div>") == text
    assert html_extract.main_text(f"<main><article><header><h1>H</h1></header><p>{long}</p><aside>a</aside><form><p>f</form></article></main>") == f"H\n\n{text}"


@pytest.mark.parametrize("head", ['<h2 id="social-history">', '<h2><span class="mw-headline" id="Related_works">', '<h3 id="search-algorithms">', '<h2 id="search">', '<section id="notice-periods"><h2>', '<section id="binary-search"><h2>', '<div class="section" id="promotion-rules"><h2>', '<h2 title="the hidden cost">', '<p data-x="a hidden gem">'])
@pytest.mark.parametrize("around", ["article", "div"])
def test_html_keeps_named_parts_of_the_text(around, head):
    long = " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."] * 3)
    closing = "".join(f"</{x.split()[0].strip('>')}>" for x in reversed(head.split("<")[1:]))
    assert html_extract.main_text(f"<body><{around}><p>{long}</p>{head}Heading{closing}<p class=notice-text>{long}</p></{around}></body>") == f"{long}\n\nHeading\n\n{long}"


def test_html_wrapper_of_most_text():
    long = " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."] * 3)
    text = f"<h1>T</h1><p>{long}</p><p>{long}</p>"
    want = f"T\n\n{long}\n\n{long}"
    for page in ("<div class='layout right-sidebar'>{}</div>", "<div id=overlay><div class='layout right-sidebar'><div class=sidebar><p>x</p></div>{}</div></div>", "<app-root class=popup>{}</app-root>", "<div hidden>{}</div>", "<fieldset>{}</fieldset>", "<div class=elementor-widget>{}</div>", "<div aria-label='Related notice'>{}</div>", "<article><div class='post social'>{}</div></article>"):
        assert html_extract.main_text(f"<body>{page.format(text)}<div class=share-buttons>Share this</div><footer>f</footer></body>") == want
    nested = "<div class=sidebar>" * 300 + text + "</div>" * 300
    assert html_extract.main_text(nested) == want
    comments = f"<div id=comments>{f'<p>{long}</p>' * 9}</div>"  # are more than the article, but not it
    for page in (f"<div>{text}</div>{comments}", f"<article>{text}</article><div class=sidebar>{f'<p>{long}</p>' * 9}</div>", f"<div>{text}</div><div class='related-posts'>{'<a href=x>more of this</a> ' * 99}</div>"):
        assert html_extract.main_text(page) == want


def test_html_still_leaves_out_what_is_named():
    long = " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."] * 3)
    for named in ("<div class=ad-container>", "<div class='page__sidebar--left'>", "<ul class=social-links>", "<div id=cookie-banner>", "<div role=navigation>", "<div aria-label='Main navigation'>", "<div class='container footer'>", "<div class='comments entry'>", "<div class='post comment'>", "<div class=site-notice>", "<div class=footer-widget>"):
        tag = named.split()[0].strip("<>")
        assert html_extract.main_text(f"<div><p>{long}</p>{named}Not this</{tag}><p>{long}</p></div>") == f"{long}\n\n{long}"


LONG = " ".join(["Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod."] * 3)


@pytest.mark.parametrize("kept", ["<p hidden>", "<p style='display:none'>", "<div class=market-share>", "<div id=notice-period>", "<div class=ad-free-reading>", "<div class='elementor-widget elementor-widget-text-editor'>", "<div class=widget-text>", "<fieldset>", "<math><mi>", "<div class='content sidebar-left-layout'>"])
def test_html_drops_nothing_else(kept):
    tags = [x.split()[0].strip("<>") for x in kept.split("<")[1:]]
    page = f"<body><div><h1>T</h1><p>{LONG}</p>{kept}{LONG}{''.join(f'</{x}>' for x in reversed(tags))}<p>{LONG}</p></div></body>"
    assert " ".join(html_extract.main_text(page).split()) == f"T {LONG} {LONG} {LONG}"


def test_html_builder_pages_of_named_blocks():
    """Every paragraph in an element of its own, each named."""
    block = "<div class='elementor-element elementor-widget'><div class=elementor-widget-container><p>{}</p></div></div>"
    page = "<body><div class=elementor-section>" + "".join(block.format(LONG) for _ in range(7)) + "</div><div class=footer-widgets><p>About us and all that.</p></div></body>"
    assert html_extract.main_text(page) == "\n\n".join([LONG] * 7)


def test_html_depth_has_no_limit():
    for depth in (600, 20_000):
        assert html_extract.main_text("<div>" * depth + "<p>one</p><p>two</p>" + "</div>" * depth) == "one\n\ntwo"


def test_html_article_of_links_is_not_the_text():
    links = "<article><ul>" + "<li><a href=x>Another story of the day</a>" * 30 + "</ul></article>"
    assert html_extract.main_text(f"<body>{links}<div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div></body>") == "\n\n".join([LONG] * 3)
    aside = "<div>" + "<p><a href=x>A link to something else</a></p>" * 30 + "</div>"
    assert html_extract.main_text(f"<body><main><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>{aside}</main></body>") == f"T\n\n{LONG}\n\n{LONG}"


def test_html_one_block_of_an_advert_is_left_out():
    for named in ("<div class=ad>", "<div class=cookie-notice>", "<aside>"):
        tag = named.split()[0].strip("<>")
        assert html_extract.main_text(f"<body><nav><a href=x>a</a></nav>{named}{LONG}</{tag}><h1>Short.</h1><p>Only this.</body>") == "Short.\n\nOnly this."


def test_html_pages_without_article():
    """Core, siblings with text and no boilerplate, with no name or tag to go by."""
    menu = "<table><tr>" + "<td><a href=x>Menu entry</a>" * 8 + "</table>"
    page = f"<body>{menu}<table><tr><td><h2>T</h2><p>{LONG}</p><p>x</p><ul><li>{LONG}<li>two</ul></td></tr></table>{menu}</body>"
    assert html_extract.main_text(page) == f"T\n\n{LONG}\n\nx\n\n{LONG}\n\ntwo"


def test_html_density_by_brute_force():
    """Every node's figures and the core, counted over the tree again for each node."""
    rng = random.Random(6)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "a", "div", "p"] if depth else ["text", "a"])
            words = " ".join(rng.choices(["lorem", "ipsum", "x"], k=rng.randint(1, 30)))
            out.append(words if kind == "text" else f"<a href=x>{words}</a>" if kind == "a" else f"<div>{tree(depth - 1)}</div>" if kind == "div" else f"<p>{words}</p>")
        return " ".join(out)

    def runs(node):
        out, run = [], ""
        for c in [*node.children, None]:
            if isinstance(c, str):
                run += c
            else:
                n = len(" ".join(run.split()))
                out, run = out + ([n] if n else []), ""
        return out

    def under(node):
        return [node, *(x for c in node.children if isinstance(c, html_extract.Node) for x in under(c))]

    def figures(node):
        own = under(node)
        linked = {id(x) for y in own if y.tag == "a" for x in under(y)}
        return sum(sum(runs(x)) for x in own), len(own) - 1, sum(sum(runs(x)) for x in own if id(x) in linked), sum(x.tag == "a" for x in own)

    def density(chars, tags, link_chars, link_tags, share):
        if not chars:
            return 0.0
        ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
        base = np.log(chars / max(1, chars - link_chars) * link_chars + share * chars + np.e)
        return chars / max(1, tags) * np.log(max(1, ratio)) / (np.log(max(base, 1 + 1e-9)) if base > 1 else 1)

    for _ in range(60):
        root = html_extract.parse(f"<body>{tree(3)}</body>")
        nodes = html_extract.measure(root)
        chars, _, links, _ = figures(root)
        share = links / chars
        total = {}
        for x in nodes:
            assert np.isclose(x.density, density(*figures(x), share))
            total[id(x)] = sum(density(*figures(c), share) for c in x.children if isinstance(c, html_extract.Node) and c.tag != "a") + sum(density(n, 0, 0, 0, share) for n in runs(x))
            assert np.isclose(x.total, total[id(x)])
        for x in nodes:
            assert np.isclose(x.best.total, max(total[id(y)] for y in under(x)))


def test_warc_round_trip(spark):
    pages = [(3, "http://a/é b", "x"), (1, "u", "x"), (2, "u\r\nbad: y", "y"), (5, None, None), (4, "u", ""), (None, "u", "z"), (9, "u", "ü" * 1000), (9, "u", "ü" * 1000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    folder = f"{tx.shared_dir(spark)}/warc-test"
    manifest = warc.write_warc(frame, folder, archive_bytes=300)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(pages)
    got = warc.read_warc(spark, f"{folder}/*.gz").collect()
    assert all(r.kind == "record" for r in got)
    first = {"x": 1, "y": 2, "": 4, "z": None, "ü" * 1000: 9}
    want = sorted((f"<urn:page:{'null' if i is None else i}>", len((t or "").encode()), warc.base32_sha1((t or "").encode()), "response" if i == first[t or ""] else "revisit") for i, _, t in pages)
    assert sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == want
    assert {(r.record_id, r.refers_to) for r in got if r.record_type == "revisit"} == {("<urn:page:3>", "<urn:page:1>"), ("<urn:page:5>", "<urn:page:4>")}
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == set(first)


def _record(k, body):
    return warc.record(k, "http://x/", body, warc.base32_sha1(body), None, False)


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_salvage(zipped):
    def pack(x):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush() if zipped else x

    bodies = [bytes(random.Random(k).choices(b"abc <>\r\n", k=400)) for k in range(6)]
    parts = [pack(_record(k, b)) for k, b in enumerate(bodies)]
    whole = b"".join(parts)
    assert [x[3]["payload"] for x in warc.salvage(whole)] == bodies

    def check(data, lost):
        found = list(warc.salvage(data))
        assert [x[3]["payload"] for x in found if x[0] == "record"] == [b for k, b in enumerate(bodies) if k not in lost]
        cover = sorted((x[1], x[2]) for x in found)
        assert cover[0][0] == 0 and cover[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cover, cover[1:]))
        assert any(x[0] == "gap" and x[3] for x in found) == bool(lost or data != whole)

    start = [sum(map(len, parts[:k])) for k in range(7)]
    damaged = bytearray(whole)
    damaged[start[2] + len(parts[2]) - 30] ^= 0x55  # inside a record
    check(bytes(damaged), {2})
    check(whole[: start[1]] + b"garbage \x1f\x8b\x08 WARC/1.1 nonsense" + whole[start[1] :], set())  # between records
    check(whole[: start[3] + 40] + whole[start[4] :], {3})  # a cut in the middle
    check(whole[: start[5] + 60], {5})  # cut off at the end
    check(whole[start[1] - 20 :], {0})  # begins within a record


def _zip(x, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(x) + c.flush()


def test_warc_salvage_after_a_long_damaged_stretch():
    bodies = [random.Random(k).randbytes(100_000) for k in range(3)]
    parts = [_zip(_record(k, b)) for k, b in enumerate(bodies)]
    whole = b"".join(parts)
    for data in (whole[10:], b"\0" * 80_000 + whole[80_000:]):
        found = list(warc.salvage(data))
        assert [x[3]["payload"] for x in found if x[0] == "record"] == bodies[1:]
        assert [x[1:3] for x in found if x[0] == "gap"] == [(0, len(parts[0]) - len(whole) + len(data))]
    plain = _record(7, whole)  # an archive as the payload of a plain record
    assert [x[3]["payload"] for x in warc.salvage(plain + parts[1] + plain)] == [whole, bodies[1], whole]


def test_warc_salvage_within_one_member():
    bodies = [bytes(random.Random(k).choices(b"abc <>\r\n", k=4000)) for k in range(40)]
    whole = _zip(b"".join(_record(k, b) for k, b in enumerate(bodies)))
    after = _zip(_record(99, b"after"))
    at = len(whole) * 3 // 4
    damaged = whole[:at] + b"\xff" * 40 + whole[at + 40 :]
    for data, least in ((damaged + after, 28), (whole[:at] + after, 28), (whole[:-8] + b"\0" * 8 + after, 40), (whole[:at], 28)):
        found = list(warc.salvage(data))
        got = [x[3]["payload"] for x in found if x[0] == "record"]
        if data.endswith(after):
            assert got.pop() == b"after"
        assert got == bodies[: len(got)] and len(got) >= least
        cover = sorted({(x[1], x[2]) for x in found})
        assert cover[0][0] == 0 and cover[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cover, cover[1:]))
        assert any(x[0] == "gap" and x[3] for x in found)


def test_warc_records_without_digest_in_a_broken_member():
    bare = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    broken = _zip(bare * 2)[:-8] + b"\0" * 8
    assert [x[3]["payload"] for x in warc.salvage(broken) if x[0] == "record" and x[3]["doubt"]] == [b"abc"] * 2
    assert not any("doubt" in x[3] for x in warc.salvage(_zip(bare)))


@pytest.mark.parametrize("version", [b"0.17", b"0.18", b"1.0", b"1.1", b"2.0"])
@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "SHA-512"])
def test_warc_versions_and_digests(version, name):
    body = b"payload of a record"
    value = hashlib.new(name.lower().replace("-", ""), body).digest()
    for digits in (value.hex(), value.hex().upper(), base64.b32encode(value).decode(), base64.b32encode(value).decode().rstrip("="), base64.b64encode(value).decode()):
        one = b"WARC/" + version + f"\r\nWARC-Type: resource\r\nWARC-Payload-Digest: {name}:{digits}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        (found,) = warc.salvage(one)
        assert found[0] == "record" and found[3]["payload"] == body and found[3]["payload_digest"] == warc.base32_sha1(body) and found[3]["checked"]
        (found,) = warc.salvage(one.replace(body, body[::-1]))
        assert found[0] == "gap" and "digest" in found[3]
    unknown = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: crc:12\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert [x[0] for x in warc.salvage(unknown)] == ["record"]


def test_warc_one_payload_of_many_pages(spark):
    frame = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("id") % 700)).alias("html"))
    folder = f"{tx.shared_dir(spark)}/warc-hot"
    warc.write_warc(frame, folder)
    got = warc.read_warc(spark, f"{folder}/*.gz", payloads=False).collect()
    text = {i: "" if i % 3 == 0 else f"p{i % 700}" for i in range(4000)}
    first: dict = {}
    for i, t in text.items():
        first.setdefault(t, i)
    assert {(r.record_id, r.record_type, r.refers_to) for r in got} == {(f"<urn:page:{i}>", "response" if first[t] == i else "revisit", None if first[t] == i else f"<urn:page:{first[t]}>") for i, t in text.items()}
    warc.write_warc(frame, folder + "2", revisit_from=1)
    kinds = {r.record_id: r.record_type for r in warc.read_warc(spark, f"{folder}2/*.gz", payloads=False).collect()}
    assert len(kinds) == 4000 and all(kinds[f"<urn:page:{i}>"] == "response" for i in range(0, 4000, 3))


def test_warc_large_record(spark):
    html = "é" * 3_000_000
    folder = f"{tx.shared_dir(spark)}/warc-large"
    warc.write_warc(spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "x")], "page_id long, url string, html string"), folder, archive_bytes=1000)
    got = {r.record_id: (r.payload_bytes, r.record_type) for r in warc.read_warc(spark, f"{folder}/*.gz").collect()}
    assert got == {"<urn:page:1>": (6_000_000, "response"), "<urn:page:2>": (6_000_000, "revisit"), "<urn:page:3>": (1, "response")}


def test_warc_empty(spark):
    folder = f"{tx.shared_dir(spark)}/warc-none"
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"no archive")] == ["gap"]


def test_base32():
    assert warc.base32_sha1(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:2000] = x[5]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    recall = []
    for q, found in got.items():
        found.sort()
        score = np.einsum("ij,j->i", x, x[q])
        score[q] = -9
        best = np.lexsort((np.arange(3000), -score))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        recall.append(len({v for _, v, _ in found} & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9
    assert [v for _, v, _ in got[1000]] == [5, *range(1001, 1020)]


def test_two_levels_of_centroids():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    two, one = ann.Quantiser(x, 128, flat=16), ann.Quantiser(x, 128)
    assert two.first is not None and one.first is None and abs(len(two.coarse) - 128) < 24 and two.bound[-1] == len(two.coarse)
    lists = two.lists(x)
    near = ((x[:, None] - two.first[None]) ** 2).sum(2).argmin(1)
    for i in range(0, 3000, 97):  # the nearest centroid below the nearest one above
        a, b = two.bound[near[i]], two.bound[near[i] + 1]
        assert lists[i] == a + ((x[i] - two.coarse[a:b]) ** 2).sum(1).argmin()
    own, code = two.encode(x)
    decoded = two.coarse[own] + np.concatenate([book[code[:, k]] for k, book in enumerate(two.books)], 1)
    assert ((x - decoded) ** 2).sum() < 0.5 * ((x - two.coarse[own]) ** 2).sum()
    q = x[5]
    distances = two.coarse @ q
    table = distances[own] + sum(t[0][code[:, k]] for k, t in enumerate(two.tables(q[None])))
    assert np.allclose(table, decoded @ q, atol=1e-4)


def test_neighbours_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann.Quantiser.__init__, "__defaults__", (5, 4))
    monkeypatch.setattr(ann, "CANDIDATES", 500)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 8))[rng.integers(0, 10, 1200)] + 0.2 * rng.normal(size=(1200, 8))
    got: dict = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -9)
    assert np.mean([len(got[q] & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in range(0, 1200, 20)]) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (20, [0.0, 2.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (1, [0.5, 0.5])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect() == []
