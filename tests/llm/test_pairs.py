"""Jaccard join, components, suffix dedup and decontamination against brute force."""
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import _text as tx
from spindrift.llm import decontaminate, jaccard_join, suffix_dedup
from tests.llm import helpers as h


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    tx.prepare(spark)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, n, num):
    rows = h.corpus()
    got = jaccard_join.jaccard_components(h.frame(spark, rows), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == h.jaccard_components(rows, n, num, 100)
    assert len(got) == len(rows)


@pytest.mark.parametrize("few", [0, 10**6])
def test_jaccard_of_large_families(spark, monkeypatch, few):
    """Hot shingles, hubs and classes: a third of the rows are copies, a third near copies of one text."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(12)
    base, other = h.sentence(rng, 120).split(), h.sentence(rng, 80)
    rows = [(i, other) for i in range(150)]
    for i in range(150, 300):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = h.sentence(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(i, h.sentence(rng, rng.randint(1, 60))) for i in range(300, 450)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(h.frame(spark, rows)).collect()}
    assert got == h.jaccard_components(rows, 3, 90, 100)


@pytest.mark.parametrize("tasks", [3, 140])
def test_sketches_of_many_tasks(spark, monkeypatch, tasks):
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 10)
    counts = np.random.default_rng(tasks).integers(0, 2**31, (tasks, 24, 128), dtype=np.uint32)
    rows = [(k, counts[t, k].tobytes()) for t in range(tasks) for k in range(24)]
    ranks, salts = jaccard_join._ranks(spark.createDataFrame(rows, "bucket int, counts binary"), 4, 90, 100)
    total = counts.astype(np.int64).sum(0).reshape(3, -1)
    assert np.array_equal(ranks, np.argsort(np.argsort(total, axis=1, kind="stable"), axis=1))
    assert np.array_equal(salts, np.maximum(1, -(-np.sort(total, axis=1) * 32 // (total.sum(1, keepdims=True) * 10 // 100))))


def test_jaccard_null_and_repeated_ids(spark):
    a, b = "x y z " * 3, " ".join(map(str, range(40)))
    frame = h.frame(spark, [(None, a), (5, a), (5, a), (7, a), (5, b), (9, b), (11, None)]).withColumn("n", F.lit(1)).withColumn("cls", F.lit("c"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()), key=str)
    assert got == sorted([(None, 3, None), (5, 3, 5), (5, 3, 5), (7, 3, 5), (5, 38, 5), (9, 38, 5), (11, 0, 11)], key=str)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(h.frame(spark, [])).collect() == []


@pytest.mark.parametrize("length", [50, 24, 131])
def test_suffix(spark, length):
    rows = h.corpus(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(h.frame(spark, rows).select("doc_id", "text"), length).collect()}
    assert got == {i: v[:4] for i, v in h.repeats(rows, length).items()}


def test_suffix_with_every_gram_hot(spark):
    rows = h.corpus(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(h.frame(spark, rows).select("doc_id", "text"), 50, hot_from=1).collect()}
    assert got == {i: v[:4] for i, v in h.repeats(rows, 50).items()}


@pytest.mark.parametrize("hot_from", [None, 1])
def test_suffix_with_all_bytes_compared(spark, hot_from):
    rows = h.corpus(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(h.frame(spark, rows).select("doc_id", "text"), 50, hot_from, True).collect()}
    assert got == {i: v[:4] for i, v in h.repeats(rows, 50).items()}


def test_suffix_runs_by_bytes_or_words(spark):
    rows = h.corpus(7)
    rows += [(300 + k, f"{'abc ' * k}\n{'a b c d e f g h i j k l m ' * 4}{'x' * k}\n" + " ".join(f"w{i}" for i in range(30))) for k in range(4)]
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(h.frame(spark, rows), 101, 200, 50).collect()}
    want = {i: v[4].decode("utf-8", "ignore") for i, v in h.repeats(rows, 101, 200, 50).items()}
    assert got == want and any(h.repeats(rows, 101)[i][1] != h.repeats(rows, 101, 200, 50)[i][1] for i, _ in rows)


def test_suffix_repeated_and_null_ids(spark):
    t, u = "abcdefghij" * 8, "the quick brown fox jumps over the lazy dog and runs off again"
    rows = [(3, t), (3, t), (3, u), (None, t), (4, t + u), (2, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeat_digests(h.frame(spark, rows).select("doc_id", "text")).collect()), key=str)
    assert got == sorted([(3, 80, 0), (3, 80, 0), (3, 62, 0), (None, 80, 0), (4, 142, 142), (2, 0, 0)], key=str)


def test_suffix_texts_keep_other_columns(spark):
    rows = h.corpus(3)
    frame = h.frame(spark, rows).withColumn("z", F.lit(7)).withColumn("uid", F.lit("u")).withColumn("changed", F.lit(1))
    got = suffix_dedup.remove_repeats(frame, 50)
    assert got.columns == [*frame.columns, "__changed"]
    want = h.repeats(rows, 50)
    assert {r.doc_id: (r.text, r.z, r.uid) for r in got.collect()} == {i: (v[4].decode("utf-8", "ignore"), 7, "u") for i, v in want.items()}


def test_suffix_empty(spark):
    assert suffix_dedup.repeat_digests(h.frame(spark, []).select("doc_id", "text")).collect() == []


def test_multikey_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, (300, 40)).astype(np.uint8)
    data[200:] = data[:100]
    at, run = suffix_dedup.equal_runs(data.reshape(-1), np.arange(300) * 40, 21, np.zeros(300, int))
    got = {frozenset(at[run == r].tolist()) for r in set(run.tolist())}
    by: dict = {}
    for i in range(300):
        by.setdefault(data[i, :21].tobytes(), []).append(i)
    assert got == {frozenset(v) for v in by.values() if len(v) > 1}


@pytest.mark.parametrize("length", [*range(5, 21), 25])
def test_masks_leave_no_gap(length):
    """Whole items with substitutions anywhere, and stretches between two equal words."""
    masks = decontaminate.MASKS if length >= decontaminate.LEAST else decontaminate.short_masks(length)
    fits = [sum(1 << (i + k) for k, bit in enumerate(m) if bit == "1") for m in masks for i in range(length - len(m) + 1)]
    for missing in itertools.combinations(range(length), length // 5):
        gone = sum(1 << k for k in missing)
        assert any(not fit & gone for fit in fits), missing


def test_short_and_edge_leaks(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (1, 4, 5, 9, 10, 12, 13, 14, 15, 19)]
    docs, want = [], set()
    for n, text in items:
        for changed in range(n // 5 + 2):
            for first in (True, False):  # at one edge, at the other
                words = text.split()
                words[slice(0, changed) if first else slice(n - changed, n)] = ["zz"] * changed
                doc = len(docs)
                docs.append((doc, " ".join(words) if n < 5 else "before it " + " ".join(words) + " and after"))
                if (changed == 0) if n < 5 else changed <= n // 5 or n - changed >= 13:
                    want.add((doc, n))
        docs.append((len(docs), text + " more"))
        if n >= 5:
            want.add((docs[-1][0], n))
    got = decontaminate.find_leaks(h.frame(spark, docs).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2))).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_leaks_of_one_repeated_word():
    word = tx.word_hashes(*[np.array(x) for x in ([97], [0], [1])])[0]
    raw, off = tx.utf8(pa.array([" ".join(["a"] * 300)]))
    seeds = decontaminate.Seeds(np.array([1]), raw, off, 13)
    n = 6000
    found = seeds.hits(np.full(n, word), np.zeros(n, np.int64))
    assert len(found) == n + 300 - 1 - 2 * 5 and seeds.stretch(np.full(n, word), 0, n, 0, 5) == (300, 300, 0)


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, h.sentence(rng, n)) for k, n in enumerate([3, 5, 9, 12, 13, 14, 20, 33, 50])] + [(99, None), (None, h.sentence(rng, 20)), (98, "")]
    docs = []
    for i in range(120):
        words = h.sentence(rng, rng.randint(0, 40)).split()
        item = rng.choice(items[:9])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            item[rng.randrange(len(item))] = "qqq"
        if i % 4:
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if i % 5 == 0 else w for w in item[: rng.randint(max(1, len(item) // 2), len(item))]]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[8][1]), (502, items[8][1] * 3)]
    got = decontaminate.find_leaks(h.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in docs:
        for k, x in items:
            n = longest_words(t, x) if i is not None and k is not None else 0
            if n:
                want[i, k] = n
    assert {(r.doc_id, r.item_id): r.n_words for r in got} == want
    assert len(want) > 30
    in_blocks = decontaminate.find_leaks(h.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=60).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, got))


def longest_words(text, item):
    return h.longest_stretch(h.plain_words(text), h.plain_words(item))


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(h.frame(spark, [(1, "a b c")]), none).collect() == []
    assert decontaminate.find_leaks(h.frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], none.schema)).collect() == []


def test_leaks_with_ties_and_repeats(spark):
    words = [f"w{k}" for k in range(20)]
    twice = " ".join(words) + " between " + " ".join(words)  # two equal stretches: the first counts
    docs = [(1, twice), (1, "other text"), (1, twice), (2, " ".join(words[:16])), (None, twice), (3, " ".join(words[:14] + ["x"] + words[15:]))]
    items = [(7, " ".join(words)), (7, " ".join(words)), (8, " ".join(words[:15])), (None, " ".join(words))]
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal, r.item_word, r.doc_word) for r in decontaminate.find_leaks(h.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 7): (20, 20, 0, 0), (1, 8): (15, 15, 0, 0), (2, 7): (16, 16, 0, 0), (2, 8): (15, 15, 0, 0), (3, 7): (20, 19, 0, 0), (3, 8): (15, 14, 0, 0)}


def test_leaks_in_a_long_text(spark):
    rng = random.Random(2)
    item = h.sentence(rng, 30)
    text = h.sentence(rng, 60_000) + " " + item + " " + "the " * 20_000
    items = [(1, item), (2, "the " * 300), (3, h.sentence(rng, 25))]
    got = {r.item_id: (r.n_words, r.doc_word) for r in decontaminate.find_leaks(h.frame(spark, [(1, text)]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (30, 60_000), 2: (300, 60_030)}
