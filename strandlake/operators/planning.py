"""Costs and geometry (O8, P17, P26, M5, M8 rows)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(size: Column, k: int, payload: int) -> Column:
    return F.ceil(size / (k * payload)).cast("bigint")


def strands(size: Column, k: int, m: int, payload: int) -> Column:
    """Data and parity strands of a container, and those of its superblock (data symbols and three times as many)."""
    n = groups(size, k, payload)
    last = F.when(size > 0, F.ceil((size - (n - 1) * (k * payload)) / payload)).otherwise(0)
    data = F.when(n > 0, (n - 1) * k + last).otherwise(0)
    return (data + n * m + 4 * math.ceil(96 / payload)).cast("bigint")


def cost(plans: DataFrame, vendors: DataFrame) -> DataFrame:
    """plans (n_strands, nt) x vendors (vendor, per_order, per_strand, per_base, max_nt, min_order; a small price list):
    adds fits and cost in exact decimals (null where the order does not fit)."""
    rows = plans.crossJoin(F.broadcast(vendors))
    fits = (F.col("nt") <= F.col("max_nt")) & (F.col("n_strands") >= F.col("min_order"))
    total = F.col("per_order") + F.col("per_strand") * F.col("n_strands").cast("decimal(18,0)") + F.col("per_base") * (F.col("n_strands") * F.col("nt")).cast("decimal(18,0)")
    return rows.withColumn("fits", fits).withColumn("cost", F.when(fits, total.cast("decimal(28,6)")))


def failure_bound(n: int, tolerated: int, loss: float) -> float:
    """Probability that more than ``tolerated`` of n symbols are lost."""
    if loss <= 0:
        return 0.0
    total = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(loss) + (n - i) * math.log1p(-loss)) for i in range(tolerated + 1))
    return max(0.0, 1.0 - total)


def tolerated_loss(k: int, m: int, target: float) -> float:
    """The largest loss at which a group fails with at most the target probability, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if failure_bound(k + m, m, mid) <= target else (low, mid)
    return low


def geometry(sizes: DataFrame, options: DataFrame, loss: float, target: float) -> DataFrame:
    """size id -> the cheapest option (k, m, payload; a small grid) whose failure bound meets the target.

    Bounds are computed once per option on the driver side of the grid.
    """
    rows = sizes.crossJoin(F.broadcast(options)).withColumn("n_strands", F.ceil(F.col("size") / (F.col("k") * F.col("payload"))) * (F.col("k") + F.col("m")))
    good = rows.where(F.col("failure") <= target)
    best = good.groupBy("id").agg(F.min(F.struct("n_strands", "k", "m", "payload")).alias("b"))
    return best.select("id", "b.*")


def symbol_positions(k: int, m: int, depth: int, parity_rows: int, interleaved: bool) -> list[tuple[int, int]]:
    """(row, position) of each strand of a stripe in file order: row by row, or position by position."""
    rows = range(depth + parity_rows)
    return [(r, p) for p in range(k + m) for r in rows] if interleaved else [(r, p) for r in rows for p in range(k + m)]


def superblock_slots(n: int, n_super: int) -> list[int]:
    """After how many data strands each superblock strand stands."""
    return [(2 * i + 1) * n // (2 * n_super) for i in range(n_super)]
