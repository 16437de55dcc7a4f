"""Tables in the cluster's shared folder, partition counts and a join that heavy keys don't slow down."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of packed records that a partition of a block shuffle should have; they are held in NumPy arrays.
PARTITION_BYTES = 128 << 20
_FOLDER = "_spindrift_folder"


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Partitions for so many bytes, and no fewer than the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the cluster's shared folder; it is deleted when the application ends.

    Only in local mode, where one machine holds all, is a folder chosen if none is set.
    """
    context = spark.sparkContext
    if getattr(context, _FOLDER, None):
        return getattr(context, _FOLDER)
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spindrift-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    own = f"{found.rstrip('/')}/spindrift-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    setattr(context, _FOLDER, own)
    return own


def table(frame: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and executors may go.

    tidy: the executors' disks are rid of the shuffle files that led to it. Spark removes them once
    the driver's garbage collector has found their plans unused, which may otherwise take long.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._spindrift_path = path
    if tidy:
        spark.sparkContext._jvm.System.gc()
    return found


def drop(frame: DataFrame) -> None:
    """Delete a table that nothing reads any more."""
    context = frame.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(frame._spindrift_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, parts: int, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, where a key may have any share of the rows.

    ``count``, a column of the table, tells how many rows have the key. Keys of at least an eighth
    of a partition's share of the ``total`` rows are at most 8 * parts: they are broadcast, and
    their rows are dealt by a salt. The rest is joined by key. The count isn't returned.
    """
    value = [c for c in table.columns if c not in (*on, count)]
    least = max(2, total // (8 * parts))
    heavy = table.where(F.col(count) >= least).select(*on, F.struct(*value).alias("_heavy"))
    light = table.where(F.col(count) < least).select(*on, F.struct(*value).alias("_light"), F.pmod(F.col(count), F.lit(1)).cast("int").alias("_salt"))  # 0, but not as a literal: the optimizer would take that out of the keys
    names = [F.col(f"`{c}`") for c in rows.columns]
    own = rows.join(F.broadcast(heavy), on, "left").select(*names, "_heavy", F.when(F.col("_heavy").isNotNull(), 1 + F.pmod(F.xxhash64(*names), F.lit(1 << 30))).otherwise(0).cast("int").alias("_salt"))
    both = own.join(light, [*on, "_salt"], "left").select(*names, F.coalesce("_heavy", "_light").alias("_found")).where("_found is not null")
    return both.select(*names, *[F.col(f"_found.{c}").alias(c) for c in value])
