"""Streams of extents into a versioned, append-only store, and reads of it.

A batch is written under its number; writing it again replaces it, so restarts do
not duplicate extents. The current state is the latest version of each extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journal


def described(extents: DataFrame) -> DataFrame:
    """Adds length and sha256."""
    return extents.withColumns({"length": F.octet_length("data").cast("long"), "sha256": F.sha2("data", 256)})


def store(stream: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Start writing a stream of (idx, data) to ``folder``; returns the query."""
    def write(batch: DataFrame, number: int) -> None:
        described(batch).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """idx, version, data, length, sha256: the latest version of each extent, or that of a snapshot."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")
    return journal.latest(rows if at is None else rows.where(F.col("version") <= at), ["idx"], "version")


def read_range(extents: DataFrame, size: int, start: int, length: int) -> DataFrame:
    """idx, data, verified of the bytes [start, start + length): only the extents that the range touches are read."""
    stop = start + length
    rows = extents.where(F.col("idx").between(start // size, (stop - 1) // size)) if length > 0 else extents.where(F.lit(False))
    first = F.greatest(F.lit(start) - F.col("idx") * size, F.lit(0))
    last = F.least(F.lit(stop) - F.col("idx") * size, F.col("length"))
    good = F.sha2("data", 256) == F.col("sha256")
    return rows.where(last > first).select("idx", F.when(good, F.substring("data", first.cast("int") + 1, (last - first).cast("int"))).alias("data"), good.alias("verified"))


def scrub(extents: DataFrame) -> DataFrame:
    """idx of extents whose bytes do not have their digest."""
    return extents.where((F.sha2("data", 256) != F.col("sha256")) | (F.octet_length("data") != F.col("length"))).select("idx")
