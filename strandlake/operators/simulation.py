"""Loss, shuffles and layout probes on tables of strands and reads (C3, C8, C10, W11, A17, section 1.4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..kernels import frames


def chance(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the row's keys alone: the same in any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def lose(strands: DataFrame, position: str, total: int, dropout: float, bursts: int = 0, length: int = 0, seed: int = 0) -> DataFrame:
    """Strands that survive independent losses and ``bursts`` runs of lost neighbours (numbered by ``position``)."""
    left = strands.where(chance(seed, position) >= dropout)
    if bursts and length and total:
        spark = strands.sparkSession
        starts = spark.range(bursts).select(F.floor(chance(seed + 1, "id") * max(1, total - length + 1)).cast("bigint").alias("s"))
        gone = starts.select(F.explode(F.sequence("s", F.col("s") + length - 1)).alias(position)).distinct()
        left = left.join(F.broadcast(gone), position, "left_anti")  # bursts x length numbers, parameters of the call
    return left


def shuffled(reads: DataFrame, number: str, window: int, seed: int = 0) -> DataFrame:
    """Adds place: reads shuffled within fixed windows of their numbers."""
    block = F.floor(F.col(number) / window)
    w = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), number), number)
    return reads.withColumn("place", (block * window + F.row_number().over(w) - 1).cast("bigint"))


def duplicated(reads: DataFrame, number: str, share: float, seed: int = 0) -> DataFrame:
    """Reads with a share of them twice; adds copy (0 or 1)."""
    return reads.withColumn("copy", F.explode(F.when(chance(seed, number) < share, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def truncated(reads: DataFrame, number: str, share: float, seed: int = 0, seq: str = "seq") -> DataFrame:
    """A share of the reads cut at a place of their own."""
    cut_at = (1 + F.floor(chance(seed + 1, number) * F.length(seq))).cast("int")
    return reads.withColumn(seq, F.when(chance(seed, number) < share, F.substring(F.col(seq), F.lit(1), cut_at)).otherwise(F.col(seq)))


def molecules(reads: DataFrame, seq: str = "seq", ends: int = 24) -> DataFrame:
    """One row: distinct molecules by their ends, either way round."""
    s = F.col(seq)
    key = F.least(F.concat(F.substring(s, 1, ends), F.substring(S.reverse_complement(s), 1, ends)), F.concat(F.substring(S.reverse_complement(s), 1, ends), F.substring(s, 1, ends)))
    return reads.where(F.length(seq) >= ends).agg(F.count_distinct(key).alias("n_molecules"))


def probe(reads: DataFrame, order: str, seq: str = "seq", sample: int = 20_000, band: int = 6) -> str | None:
    """The profile whose layout the first reads fit: at least a tenth lie near its length, and most parse. None if none parses.

    The decision is the driver's, over a bounded sample (a parameter).
    """
    rows = [r[seq] for r in reads.select(order, seq).orderBy(order).limit(sample).collect()]
    best, most = None, 0
    for name, (layout, _, _) in frames.PROFILES.items():
        near = [s for s in rows if abs(len(s) - layout.strand_nt) <= band]
        if len(near) < max(1, len(rows) // 10):
            continue
        exact = [frames.codes(s) for s in near if len(s) == layout.strand_nt][:4000]
        score = 0
        for turn in (False, True):
            codes = [frames.codes(turned_round(frames.sequence(c))) for c in exact] if turn else exact
            if codes:
                f, e, _ = frames.strip(layout, np.stack(codes))
                score += int(frames.parse(layout, f, e).ok.sum())
        if score > most:
            best, most = name, score
    return best


def turned_round(seq: str) -> str:
    return seq.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
