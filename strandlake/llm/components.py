"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, files_for, prepare


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """As ``cut``, but as Parquet: a checkpoint keeps the optimizer's size estimate, whose digits double with every join."""
    prepare(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/labels-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(files_for(rows))).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame, keep=cut) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: bigint) reaches.

    A round takes the least label among a node and its neighbours, then follows
    the label twice (pointer jumping), so the number of rounds grows with the
    logarithm of the longest path. Each round is cut by a checkpoint. Labels of
    a large component meet in one key only as a one-row-per-label lookup, in a
    join that AQE can split. ``keep`` cuts the end of a round; graphs with long
    chains need ``written`` there. Repeated edges count once; an empty table gives
    an empty result. (``operators.clustering`` has the same for reads; this package
    stands for itself.)
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()  # nodes are no more; the tables of a round get files by their number
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), n)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = cut(labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root"), n)
        lookup = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        jumped = cut(step.join(lookup, "next", "left").select("node", F.coalesce("up", "next").alias("next"), "root"), n)
        again = jumped.select(F.col("node").alias("next"), F.col("next").alias("up"))
        new = keep(jumped.join(again, "next", "left").select("node", F.coalesce("up", "next").alias("next"), "root"), n)
        labels = new.select("node", F.col("next").alias("root"))
        if new.where("next != root").isEmpty():
            return labels
