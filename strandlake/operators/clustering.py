"""Sketches, candidate pairs, verification, components (P31-P32, J4-J8, D16 rows)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..kernels import sketches as kernel
from ..kernels.distance import within
from .common import cut


def _least(seq: Column, k: int, slots: int, both: bool) -> Column:
    """Array of 2 * hash + turned: the least of each slot; empty without a k-mer."""
    @F.arrow_udf("array<bigint>")
    def found(values: pa.Array) -> pa.Array:
        least = kernel.least(values.to_pylist(), k, slots, both)
        there = least != kernel.NONE
        ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(least[there]))

    return found(seq)


def sketch(reads: DataFrame, read_id: str, seq: Column, k: int = 12, slots: int = 32, stranded: bool = True) -> DataFrame:
    """read id, slot, hash: the least k-mer hash of each slot (hash modulo ``slots``). A row sends one value a slot."""
    hashes = F.transform(_least(seq, k, slots, not stranded), lambda x: F.shiftright(x, 1))
    rows = reads.select(read_id, F.explode(hashes).alias("hash"))
    return rows.groupBy(read_id, (F.col("hash") % slots).alias("slot")).agg(F.min("hash").alias("hash"))


def bucket_cap(sketches: DataFrame, budget: int, floor: int = 2) -> int:
    """The largest bucket size that exists whose pairs, with all smaller ones', fit the budget; driver side, a histogram only."""
    sizes = sketches.groupBy("slot", "hash").count().groupBy("count").agg(F.count("*").alias("n")).orderBy("count")
    used, cap = 0, floor
    for r in sizes.toLocalIterator():
        used += r["n"] * r["count"] * (r["count"] - 1) // 2
        if used > budget:
            break
        cap = max(cap, r["count"])
    return cap


def candidates(sketches: DataFrame, read_id: str, shared: int = 2, cap: int = 256) -> DataFrame:
    """a, b, n_shared: pairs (a < b) that meet in at least ``shared`` slots; buckets above ``cap`` give none."""
    sizes = sketches.groupBy("slot", "hash").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, cap))
    rows = sketches.join(sizes.drop("_n"), ["slot", "hash"], "left_semi")
    left, right = rows.select("slot", "hash", F.col(read_id).alias("a")), rows.select("slot", "hash", F.col(read_id).alias("b"))
    return left.join(right, ["slot", "hash"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= shared)


def oriented_sketch(reads: DataFrame, read_id: str, seq: Column, k: int = 12, slots: int = 32) -> DataFrame:
    """As an unstranded ``sketch``, with turned: 1 if the k-mer of the slot is the reverse complement of what the read holds."""
    rows = reads.select(read_id, F.explode(_least(seq, k, slots, True)).alias("_h"))
    least = rows.groupBy(read_id, (F.shiftright("_h", 1) % slots).alias("slot")).agg(F.min("_h").alias("_h"))
    return least.select(read_id, "slot", F.shiftright("_h", 1).alias("hash"), F.col("_h").bitwiseAND(1).cast("int").alias("turned"))


def oriented_candidates(sketches: DataFrame, read_id: str, shared: int = 2, cap: int = 256) -> DataFrame:
    """a, b, n_shared, rel: ``candidates`` of an ``oriented_sketch``; rel is 1 if most shared slots have the reads turned to each other."""
    pairs = candidates(sketches, read_id, shared, cap)
    side = lambda n: sketches.select("slot", "hash", F.col(read_id).alias(n), F.col("turned").alias(f"_{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "slot", "hash"])
    return met.groupBy("a", "b", "n_shared").agg((2 * F.sum((F.col("_a") != F.col("_b")).cast("int")) > F.count("*")).cast("int").alias("rel"))


def verified(pairs: DataFrame, reads: DataFrame, read_id: str, seq: str, share: float = 0.3) -> DataFrame:
    """a, b, distance: pairs whose edit distance is at most ``share`` of the longer one; lengths are compared first.

    Pairs with a column rel compare a with the reverse complement of b where it is 1, and keep it.
    """
    rel = ["rel"] if "rel" in pairs.columns else []
    side = lambda n: reads.select(F.col(read_id).alias(n), F.col(seq).alias(f"_{n}"))
    both = pairs.select("a", "b", *rel).join(side("a"), "a").join(side("b"), "b")
    if rel:
        both = both.withColumn("_b", F.when(F.col("rel") == 1, S.reverse_complement(F.col("_b"))).otherwise(F.col("_b")))
    longest = F.greatest(F.length("_a"), F.length("_b"))
    most = F.floor(share * longest).cast("int")
    near = both.where(F.abs(F.length("_a") - F.length("_b")) <= most)
    return near.withColumn("distance", _distance(F.col("_a"), F.col("_b"), most)).where(F.col("distance").isNotNull()).select("a", "b", *rel, "distance")


def _distance(left: Column, right: Column, most: Column) -> Column:
    """The edit distance, of many pairs at once; null where it is over ``most``."""
    @F.arrow_udf("int")
    def found(left: pa.Array, right: pa.Array, most: pa.Array) -> pa.Array:
        n = within(left.to_pylist(), right.to_pylist(), most.to_numpy(zero_copy_only=False))
        return pa.array(n, pa.int32(), mask=n < 0)

    return found(left, right, most)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reached; minimum labels with pointer jumping, each round cut by a checkpoint."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = cut(label.join(near, "node").select("node", F.least("root", "near").alias("next"), F.col("root").alias("old")))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        new = cut(step.join(up, "next", "left").select("node", F.coalesce("up", "next").alias("root"), "old"))
        label = new.select("node", "root")
        if new.where("root != old").isEmpty():
            return label


def oriented_components(edges: DataFrame) -> DataFrame:
    """node, root, flipped: as ``components``, with the parity of edges (a, b, rel 0/1) along the path to the root.

    Each node becomes two, one an orientation; a component with a contradiction joins both and counts as not flipped.
    """
    double = lambda c, o: F.col(c) * 2 + o
    pairs = edges.select(double("a", F.lit(0)).alias("a"), double("b", F.col("rel")).alias("b")).union(edges.select(double("a", F.lit(1)).alias("a"), double("b", 1 - F.col("rel")).alias("b")))
    labels = components(pairs)
    return labels.select(F.floor(F.col("node") / 2).cast("long").alias("node"), (F.col("node") % 2).alias("side"), F.col("root")).groupBy("node").agg(
        F.floor(F.min("root") / 2).cast("long").alias("root"), (F.min(F.struct("root", "side"))["side"] != (F.min("root") % 2)).alias("flipped")
    )


def best_leader(orphans: DataFrame, leaders: DataFrame, key: str = "id", least: int = 1) -> DataFrame:
    """orphan, leader, n_shared: the leader with the most minimizers in common, the smallest id of equals."""
    pairs = orphans.select(F.col(key).alias("orphan"), F.explode("minimizers").alias("m")).join(leaders.select(F.col(key).alias("leader"), F.explode("minimizers").alias("m")), "m")
    counts = pairs.groupBy("orphan", "leader").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy("orphan").agg(F.max(F.struct(F.col("n"), (-F.col("leader")).alias("l"))).alias("b"))
    return best.select("orphan", (-F.col("b.l")).alias("leader"), F.col("b.n").alias("n_shared"))
