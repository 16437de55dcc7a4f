"""What changed between two states of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(before: DataFrame, after: DataFrame, key: str, value: str, trust_null: bool = False) -> DataFrame:
    """(key, status): added, removed, modified or kept. One full outer join on the key.

    Null keys are equal to each other. A null value is a value: null on both sides is kept, on one
    side modified; with trust_null, a null value before says nothing and the row is kept. Keys are
    expected once on either side; repeated ones give a row for each pair. Empty tables: all added, or
    all removed.
    """
    a = before.select(F.col(key).alias("a"), F.col(value).alias("old"), F.lit(True).alias("was"))
    b = after.select(F.col(key).alias("b"), F.col(value).alias("new"), F.lit(True).alias("is"))
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    if trust_null:
        differs = differs & F.col("old").isNotNull()
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(differs, "modified").otherwise("kept")
    return a.join(b, F.col("a").eqNullSafe(F.col("b")), "full_outer").select(F.coalesce("a", "b").alias(key), status.alias("status"))
