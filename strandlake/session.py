"""What a session needs for Python workers to import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Put the folder above this package on the workers' path (a cluster may ship it by other means, then this adds nothing)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def builder(name: str = "strandlake", cores: str = "*"):
    """A local session with the settings that tests and benches use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    )
