"""The corpus pipeline over ``documents``: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents, and further ones, whatever their names, as they came. An
empty table stays empty; rows without a doc_id go through all stages that look at their text alone,
and are never dropped for another row's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import _text as tx
from spindrift.llm import decontaminate as dc
from spindrift.llm import jaccard_join as jj
from spindrift.llm import lang_id as li
from spindrift.llm import sentencepiece_codec as sc
from spindrift.llm import suffix_dedup as sd

#: Languages to keep, as ``lang`` names them; None keeps every learned one.
LANGUAGES: frozenset[str] | None = None
#: Any 51 words take this many bytes; shorter repeats are never passages of over 50 words.
REPEAT_WINDOW = 101
#: A repeat goes if it has this many bytes (less than a passage of over 50 words takes at usual word lengths, more than common phrases and lines) or more than so many words.
REPEAT_BYTES, REPEAT_WORDS = 200, 50


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among the ids (one column)."""
    (gone,) = _free(docs, "gone")
    return docs.join(ids.select(F.col(ids.columns[0]).alias(gone)).distinct(), F.col("doc_id") == F.col(gone), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose predicted language isn't wanted (LANGUAGES); a null lang becomes the predicted one.

    Learned from the rows that have a lang. Without any such row no language can be told: then only
    documents without a letter go. Null and empty texts have no letter. Repeated rows are judged
    alike; of equally likely languages the first in code-point order counts.
    """
    tx.prepare(spark)
    model = li.learn(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found, score = _free(docs, "found", "score")
    told = li.predict_languages(docs, model, docs.columns, (found, score)).where(F.col(found) != "und")
    if LANGUAGES is not None:
        told = told.where(F.col(found).isin(*LANGUAGES))
    return told.withColumn("lang", F.coalesce("lang", found)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked by a similarity of 0.8 or more of their five-word shingles.

    Rows without a doc_id stay, and so do null and empty texts, which are linked with nothing. Rows
    of one doc_id are one document: all its different texts stay or go together. Of rows equal in
    doc_id and text, that with the smallest other columns (written as JSON) stays.
    """
    tx.prepare(spark)
    found = jj.jaccard_components(docs, n=5, num=80, den=100)
    kept = _without(docs, found.where("component_id != doc_id").select("doc_id"))
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1):
        return kept
    rest = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    other = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in rest.items()])
    once = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min_by(other, F.to_json(other)).alias("other"))
    return once.select(*[F.col(f"other.{rest[c]}").alias(c) if c in rest else F.col(c) for c in docs.columns]).union(kept.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has: of at least REPEAT_BYTES bytes, or more than REPEAT_WORDS words.

    A document of which nothing but white space is left goes; n_chars is counted anew where the
    text changed. Null and empty texts and rows without a doc_id stay as they are; rows of one
    doc_id take nothing from each other.
    """
    tx.prepare(spark)
    (changed,) = _free(docs, "changed")
    found = sd.remove_repeats(docs, REPEAT_WINDOW, REPEAT_BYTES, REPEAT_WORDS, changed).where(~F.col(changed) | (F.length(F.trim("text")) > 0))
    return found.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a stretch with a benchmark item.

    Null and empty texts share none; rows without a doc_id stay. All rows of a doc_id go if one of
    them leaks.
    """
    tx.prepare(spark)
    return _without(docs, dc.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of each row that is left; a null text has null ids, an empty one none."""
    tx.prepare(spark)
    return sc.encode(docs, ["doc_id"])


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

#: SQL has no means for the models and exact byte strings of the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what one returns is written and read again."""
    tx.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = tx.table(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before:
            tx.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
