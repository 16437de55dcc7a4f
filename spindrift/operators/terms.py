"""Terms that tell groups of texts apart: tf-idf (Sparck Jones 1972)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_terms(texts: DataFrame, group: str, text: str, top: int, shortest: int = 1) -> DataFrame:
    """(group, rank, term, n_texts, weight): the ``top`` words of each group by weight = share of its texts that hold the word x ln(groups / groups that hold it), ties in alphabetical order.

    Words are runs of letters, lower-cased, of at least ``shortest`` letters. Null texts take no part,
    rows of a null group neither; a group without words has no rows. A word counts once in a text.
    Counts are partially aggregated; the window ranks distinct terms with a rank limit, which Spark
    applies before it shuffles.
    """
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    texts = texts.where(F.col(text).isNotNull() & F.col(group).isNotNull())
    counts = texts.select(group, F.explode(words).alias("term")).where(F.length("term") >= max(1, shortest)).groupBy(group, "term").agg(F.count("*").alias("n_texts"))
    sizes = texts.groupBy(group).agg(F.count("*").alias("size"))
    spread = counts.groupBy("term").agg(F.count("*").alias("n_groups"))
    total = sizes.agg(F.count("*").alias("groups"))
    weight = F.round(F.col("n_texts") / F.col("size") * F.log(F.col("groups") / F.col("n_groups")), 9)
    rows = counts.join(spread, "term").join(sizes, group).crossJoin(F.broadcast(total)).withColumn("weight", weight)  # total is one row
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select(group, "rank", "term", "n_texts", "weight")
