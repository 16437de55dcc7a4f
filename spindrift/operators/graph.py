"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a partial aggregation and an equi-join; nothing is collected but two numbers for
each round, which tell whether the edges still change. Each round ends in a table in the shared
folder, so the lineage stays short and lost executors cost one round at most. Hubs, which large
stars make by design, are joined by way of a bounded broadcast and a salt (``shared.spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the smallest id that can be reached.

    Null ends and loops are ignored; repeated edges are one edge; no edges give no rows.
    """
    now = shared.table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    parts = shared.partitions(now.sparkSession)
    digest = lambda: tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
    state = digest()
    while state[0]:
        sym = now.union(now.select("lo", "hi"))
        low = sym.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")).select("hi", F.least("hi", "m").alias("m"), "n")
        large = shared.spread_join(sym, low, ["hi"], "n", parts, 2 * state[0]).where("lo > hi and lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        both = shared.spread_join(large, low, ["hi"], "n", parts, 2 * state[0])  # large has no more rows than sym
        pairs = both.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(both.select("hi", F.col("m").alias("lo")))
        before, now = now, shared.table(pairs.distinct(), "edges")
        shared.drop(before)
        old, state = state, digest()
        if state == old:
            break
    roots = now.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
