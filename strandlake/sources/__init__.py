"""Python data sources; ``register(spark)`` makes them known by name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from ..session import prepare
    from .extents import ExtentSource
    from .fastx import FastxSource
    from .generator import GeneratorSource
    from .packed import PackedSource

    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # record ranges of packed files
    for source in (FastxSource, PackedSource, GeneratorSource, ExtentSource):
        spark.dataSource.register(source)
