"""Pools of reads and records: unions, collisions, orders, halves, refusals (U, F5, F7, F9, T rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: A claim may name so many addresses a record, and so many in any case.
EVIDENCE_FACTOR, EVIDENCE_FLOOR = 8, 1 << 20


def accepted_by(paths: dict[str, DataFrame], address: list[str]) -> DataFrame:
    """The rows of all paths with path (name): of an address that several paths accept, the first path's rows stay."""
    rows = None
    for rank, (name, df) in enumerate(paths.items()):
        own = df.withColumns({"path": F.lit(name), "_rank": F.lit(rank)})
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy(*address).agg(F.min("_rank").alias("_rank"))
    return rows.join(best, [*address, "_rank"]).drop("_rank")


def mixed(pools: list[DataFrame], tag: str, archive: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, tag and n_archives of tags that several archives claim): a pool with such a tag can't be told apart."""
    rows = pools[0]
    for p in pools[1:]:
        rows = rows.unionByName(p)
    return rows, rows.groupBy(tag).agg(F.count_distinct(archive).alias("n_archives")).where("n_archives > 1")


def contaminated(reads: DataFrame, junk: DataFrame, source: str = "source") -> DataFrame:
    """``reads`` and ``junk``, which has the source -1."""
    return reads.unionByName(junk.withColumn(source, F.lit(-1).cast(reads.schema[source].dataType)))


def set_differences(listed: DataFrame, found: DataFrame, path: str, digest: str) -> DataFrame:
    """path, fault of files that are not there (MISSING), not listed (EXTRA) or different (CHANGED)."""
    both = listed.select(path, F.col(digest).alias("_a"), F.lit(1).alias("_l")).join(found.select(path, F.col(digest).alias("_b"), F.lit(1).alias("_f")), path, "full_outer")
    fault = F.when(F.col("_f").isNull(), "MISSING").when(F.col("_l").isNull(), "EXTRA").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return both.select(path, fault.alias("fault")).where("fault IS NOT NULL")


def halves(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Adds half (0 or 1): disjoint halves by a hash of the key, the same in any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return rows.withColumn("half", (bits % 2).cast("int"))


def unplaced(reads: DataFrame, accepted: Column, length: Column, least: int) -> DataFrame:
    """Reads that no path accepted and that are long enough to try again."""
    return reads.where(~accepted & (length >= least))


def inclusion(reads: DataFrame, drift: Column, distance: Column, length: int, window: tuple[int, int], share: float, excluded: float) -> DataFrame:
    """Adds used: window_out (length drift or far too many edits), excluded (too many edits) or kept."""
    used = F.when(~drift.between(*window), "window_out").when(distance > share * length, "window_out").when(distance > excluded * length, "excluded").otherwise("kept")
    return reads.withColumn("used", used)


def unsupported_claims(claims: DataFrame, records: Column) -> DataFrame:
    """claimed, data_symbols, limit of self-descriptions (k, m, payload, size) that promise far more than ``records`` can bear out."""
    symbols = F.ceil(F.col("size") / F.col("payload")).cast("bigint")
    claimed = F.ceil(F.col("size") / (F.col("k") * F.col("payload"))).cast("bigint") * (F.col("k") + F.col("m"))
    out = claims.withColumns({"data_symbols": symbols, "claimed": claimed, "limit": EVIDENCE_FACTOR * records + EVIDENCE_FLOOR})
    return out.where((F.col("data_symbols") > records) & (F.col("claimed") > F.col("limit")))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Adds place (from 0): most shared slots first, then by the pair."""
    return numbered(pairs, [F.desc("n_shared"), "a", "b"], "place")


def in_address_order(rows: DataFrame, address: list[str]) -> DataFrame:
    """Adds place (from 0) in the order of unique addresses: range partitions, each sorted (and spilled) for itself."""
    return numbered(rows, address, "place")


def first_violations(screened: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """The first ``most`` rows with a violation, in order (a report: the limit is the feature)."""
    return screened.where(F.col("violations") > 0).orderBy(*order).limit(most)


def latest_versions(models: DataFrame, name: str, version: str) -> DataFrame:
    """name, version: the highest version of each name."""
    from ..functions.text import version_key

    best = models.withColumn("_k", version_key(F.col(version))).where("_k IS NOT NULL").groupBy(name).agg(F.max_by(version, "_k").alias(version))
    return best.select(name, version)


def adjacent_sites(sites: DataFrame, ref: list[str], site: str) -> DataFrame:
    """ref, n, n_adjacent: distinct sites, and those whose next site is a site too (an equi join on site + 1)."""
    own = sites.select(*ref, site).distinct()
    after = own.select(*ref, (F.col(site) - 1).alias(site), F.lit(1).alias("_next"))
    return own.join(after, [*ref, site], "left").groupBy(*ref).agg(F.count("*").alias("n"), F.count("_next").alias("n_adjacent"))
