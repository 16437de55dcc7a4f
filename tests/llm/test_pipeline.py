"""The pipeline against a brute-force version of its stages."""
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spindrift.llm import _pieces as pc
from spindrift.llm import _text as tx
from tests.llm import helpers as h
from tests.llm.test_texts import best_path


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    tx.prepare(spark)
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    items = [(k, h.sentence(rng, rng.randint(15, 40), "mnopqrs")) for k in range(4)]
    passage = h.sentence(rng, 60, "tuvwxyz")
    rows = [r for r in h.corpus(8) if r[0] != 208]
    for k in range(300, 312):
        text = h.sentence(rng, 60, "ijklmno")
        if k % 3 == 0:
            words = items[k % 4][1].split()
            words[7] = "changed"
            text += " " + " ".join(words)
        if k % 2 == 0:
            text = passage + "\n" + text
        rows.append((k, text))
    rows += [(400, passage), (401, "12 34")]
    h.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_run(spark, tables):
    folder, rows, items = tables
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    component = h.jaccard_components(kept, 5, 80, 100)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    left = {i: v for i, v in h.repeats(kept, corpus_pipeline.REPEAT_WINDOW, corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS).items()}
    kept = [(i, left[i][4].decode("utf-8", "ignore") if left[i][1] else t) for i, t in kept]
    kept = [(i, t) for i, t in kept if not left[i][1] or t.strip(" ")]
    kept = [(i, t) for i, t in kept if not any(h.longest_stretch(h.plain_words(t), h.plain_words(x)) for _, x in items)]
    vocab = pc.load(tx.vocabulary_path())
    got = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {i for i, _ in kept}
    assert 0 < len(got) < len(rows) - 20
    assert got == {i: tuple(best_path(vocab, t)) for i, t in kept}


def test_stages_keep_the_columns(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.dtypes == docs.dtypes
        docs = tx.table(found, "stage")


def _odd(spark, folder):
    """Nulls, repeats and columns whose names the stages could use themselves."""
    text = "the quick brown fox jumps over the lazy dog and runs off again " * 6
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None), (3, None, "en"), (4, "", None), (None, text, "en"), (None, None, None), (5, "one two", None), (5, "three four", "en"), (6, "12 34", "en")]
    frame = h.frame(spark, rows)
    frame = frame.withColumn("lang", F.when(F.col("doc_id").isin(2, 4) | F.col("doc_id").isNull() & F.col("text").isNull(), None).otherwise(F.col("lang")))
    for k, c in enumerate(("gone", "_gone", "found", "score", "changed", "uid", "__lang", "__score", "__gone", "__changed", "__leaking", "__text", "other", "component_id", "n", "cls", "rep", "item_id", "a.b", "c0")):
        frame = frame.withColumn(c, F.lit(k))
    return frame.withColumn("held", F.create_map(F.lit("k"), F.lit(1)))


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns_nulls_and_repeats(spark, tables, k):
    docs = _odd(spark, tables[0])
    found = corpus_pipeline.STAGES[k][1](spark, docs, tables[0])
    assert found.columns == docs.columns and [f.dataType for f in found.schema.fields] == [f.dataType for f in docs.schema.fields]
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = rows[0][1]
    if k == 0:
        want = [x for x in rows if x[1] and x[0] != 6]
    elif k == 1:  # 2 has the text of 1; equal rows of 1 are one
        want = [x for n, x in enumerate(rows) if x[0] != 2 and n != 1]
    elif k == 2:  # all of 2's text is in 1
        want = [(i, "" if t is None and i is not None else t) for i, t in rows if i != 2]
    else:
        want = rows
    assert got == sorted(want, key=str) and text
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), tables[0]).collect() == []


def test_tokens_of_odd_rows(spark, tables):
    docs = _odd(spark, tables[0])
    got = corpus_pipeline.tokens(spark, docs, tables[0]).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert all((r.ids is None) == (r.doc_id == 3 or r.doc_id is None and not r.n_tokens) for r in got)


def test_language_stage_uses_the_prediction(spark, tables, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = docs.where("lang is not null and text rlike '[a-z]{3}'")
    half = known.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    true = {r.doc_id: r.lang for r in known.collect()}
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, half, "").collect()}
    assert set(kept) == set(true)
    filled = [i for i in true if i % 3 == 0]
    assert sum(kept[i] == true[i] for i in filled) >= 0.95 * len(filled) and all(kept[i] == true[i] for i in true if i % 3)
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", frozenset(["en"]))
    english = {r.doc_id for r in corpus_pipeline.language(spark, known, "").collect()}
    right = {i for i, x in true.items() if x == "en"}
    assert len(english ^ right) <= 0.05 * len(true) and len(right) < len(true)


def test_language_stage_without_labels(spark, tables):
    docs = h.frame(spark, [(1, "some text"), (2, "12"), (3, None), (None, "x")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, tables[0]).collect()} == {1, None}


def test_empty_documents(spark, tables, tmp_path):
    h.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_query_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
