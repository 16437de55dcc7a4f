"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None, recursive: bool = True) -> DataFrame:
    """(path, modified, n_bytes) of files, with one of the suffixes (in any case) if such are given. A missing folder is an error, an empty one gives no rows. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"))
    return found if suffixes is None else found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def image_files(spark: SparkSession, folder: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``files`` of images by their suffix."""
    return files(spark, folder, suffixes, recursive)


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ok, height, width, channels, data) of a folder's images, rows of pixels from the top; ok is false, and the rest null, where Spark's decoder rejects a file."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    ok = F.col("image.height") > 0
    return rows.select(F.col("image.origin").alias("path"), ok.alias("ok"), *[F.when(ok, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])
