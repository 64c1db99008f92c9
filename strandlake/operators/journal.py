"""Versioned extents and journals (W10, W16, ST5-ST7, ST13, W15, W17 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key: one aggregation, no window sort."""
    rest = [c for c in versions.columns if c not in (*key, version)]
    best = versions.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("r"))
    return best.select(*key, "r.*")


def as_of(versions: DataFrame, key: list[str], version: str, at: int) -> DataFrame:
    """The snapshot that was current at version ``at``; the filter reaches the scan."""
    return latest(versions.where(F.col(version) <= at), key, version)


def gaps(journal: DataFrame, key: list[str], seq: str) -> DataFrame:
    """key, seq, expected: entries whose number is not the one after the entry before."""
    before = F.lag(seq).over(Window.partitionBy(*key).orderBy(seq))
    return journal.withColumn("expected", F.coalesce(before + 1, F.lit(0))).where(F.col(seq) != F.col("expected")).select(*key, seq, "expected")


def anchors(log: DataFrame, key: list[str], seq: str) -> DataFrame:
    """key, n, last: entries and the last MAC of each chain, to be kept apart from the log."""
    return log.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct(seq, "mac"))["mac"].alias("last"))


def broken_links(log: DataFrame, key: list[str], seq: str, payload: str, secret: bytes) -> DataFrame:
    """Entries whose MAC does not follow from the stored MAC before, their number and their payload.

    Each link is checked for itself, so a chain of any length is checked in parallel; without the
    secret no changed entry can be given a fitting MAC.
    """
    from .archive import hmac_sha256

    before = F.coalesce(F.lag("mac").over(Window.partitionBy(*key).orderBy(seq)), F.lit(""))
    text = F.concat(F.col("_before"), F.lit("|"), F.col(seq).cast("string"), F.lit("|"), F.coalesce(payload, F.lit("")))
    fits = F.col("mac") == hmac_sha256(secret, F.encode(text, "UTF-8"))
    return log.withColumn("_before", before).where(~F.coalesce(fits, F.lit(False))).select(*key, seq)


def unanchored(log: DataFrame, kept: DataFrame, key: list[str], seq: str) -> DataFrame:
    """key, state of chains that are not what their anchors (kept apart) say: TRUNCATED, EXTENDED, REPLACED or LOST."""
    both = kept.join(anchors(log, key, seq).select(*key, F.col("n").alias("_n"), F.col("last").alias("_last")), key, "full_outer")
    state = (
        F.when(F.col("_n").isNull(), "LOST").when(F.col("n").isNull() | (F.col("_n") > F.col("n")), "EXTENDED")
        .when(F.col("_n") < F.col("n"), "TRUNCATED").when(F.col("last") != F.col("_last"), "REPLACED")
    )
    return both.select(*key, state.alias("state")).where("state IS NOT NULL")


def records(entries: DataFrame, key: list[str], seq: str, body: str, checksum: str) -> DataFrame:
    """Adds valid: whether the entry's CRC-32 is that of its bytes and its number follows the one before."""
    before = F.lag(seq).over(Window.partitionBy(*key).orderBy(seq))
    follows = F.col("_before").isNull() | (F.col(seq) == F.col("_before") + 1)
    whole = F.coalesce(F.crc32(F.col(body).cast("binary")) == F.col(checksum), F.lit(False))
    return entries.withColumn("_before", before).withColumn("valid", whole & follows).drop("_before")


def torn_tail(entries: DataFrame, key: list[str], seq: str, valid: str) -> DataFrame:
    """key, n_valid, state: CLEAN, TORN_TAIL (only the last entry is invalid) or CORRUPT."""
    out = entries.groupBy(*key).agg(F.count_if(valid).alias("n_valid"), F.count("*").alias("n"), F.max(seq).alias("last"), F.min(F.when(~F.col(valid), F.col(seq))).alias("first_bad"))
    state = F.when(F.col("first_bad").isNull(), "CLEAN").when(F.col("first_bad") == F.col("last"), "TORN_TAIL").otherwise("CORRUPT")
    return out.select(*key, "n_valid", state.alias("state"))


def replays(requests: DataFrame, nonce: list[str], ts: str, window: str = "600 seconds") -> DataFrame:
    """Adds replay: whether the nonce was seen within the window before."""
    before = F.lag(ts).over(Window.partitionBy(*nonce).orderBy(ts, "event_id"))
    return requests.withColumn("replay", F.coalesce(F.col(ts) <= before + F.expr(f"INTERVAL {window}"), F.lit(False)))


def cached(extents: DataFrame, size: str, used: str, tie: str, most: int) -> DataFrame:
    """What an LRU cache of ``most`` bytes would still hold: the most recently used whose sizes fit together.

    Sizes are first summed by minute of use, so that only the minute at the edge is ordered row by row.
    """
    minute = F.date_trunc("minute", F.col(used))
    per = extents.groupBy(minute.alias("_m")).agg(F.sum(size).alias("_s"))
    later = F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_m")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = extents.withColumn("_m", minute).join(per.withColumn("_later", later).drop("_s"), "_m")
    inside = F.sum(size).over(Window.partitionBy("_m").orderBy(F.desc(used), F.desc(tie)))
    return rows.where(F.col("_later") <= most).withColumn("_sum", F.col("_later") + inside).where(F.col("_sum") <= most).drop("_m", "_later", "_sum")


def increase(metrics: DataFrame, labels: list[str], ts: str, value: str, seconds: int, tie: str) -> DataFrame:
    """Adds increase and rate of a counter over the trailing window of event time.

    The increase is the sum of the steps between neighbouring samples of the window; a step
    down is a reset, after which the counter began at zero again.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    series = Window.partitionBy(*labels)
    before = F.lag(value).over(series.orderBy(at, tie))
    step = F.when(before.isNull(), 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    w = series.orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    entered = F.min(F.struct("_at", tie, "_step")).over(w)["_step"]  # leads into the window's first sample
    grown = F.sum("_step").over(w) - entered
    return metrics.withColumn("_at", at).withColumn("_step", step.cast("double")).withColumn("increase", grown).withColumn("rate", grown / seconds).drop("_at", "_step")
