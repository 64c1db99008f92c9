"""Archives: chunks, dedup, Merkle trees, integrity (A3, A18, J9-J12, J17, E rows)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered


def chunks(files: DataFrame, file_id: str, text: str, size: int = 256) -> DataFrame:
    """file id, pos, data, chunk_id (SHA-256 of the bytes) of each piece of ``size`` characters."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = files.select(file_id, F.posexplode(pieces).alias("pos", "data"))
    return rows.withColumn("chunk_id", F.sha2(F.encode("data", "UTF-8"), 256))


def dedup(refs: DataFrame, file_id: str) -> DataFrame:
    """chunk_id, idx, n_refs: distinct chunks numbered by first occurrence."""
    firsts = refs.groupBy("chunk_id").agg(F.min(F.struct(file_id, "pos")).alias("first"), F.count("*").alias("n_refs"))
    return numbered(firsts, ["first"]).select("chunk_id", "idx", "n_refs")


def references(refs: DataFrame, table: DataFrame, file_id: str) -> DataFrame:
    """file id, pos, idx: each file's chunks by number."""
    return refs.select(file_id, "pos", "chunk_id").join(table.select("chunk_id", "idx"), "chunk_id").select(file_id, "pos", "idx")


def hmac_sha256(key: bytes, data: Column) -> Column:
    """HMAC-SHA-256 from two nested digests (hexadecimal)."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), data), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


def leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"\0"), data), 256)


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """level, pos, hash of all nodes; ``leaves``: pos (0, 1, ...), hash. A node without a partner moves up as it is.

    Each round halves the rows; a level is one aggregation without any sort beyond the pair.
    """
    level, n = leaves.select(F.lit(0).alias("level"), F.col("pos").cast("bigint").alias("pos"), "hash"), 0
    out = level = cut(level)
    size = level.count()
    while size > 1:
        n, size = n + 1, -(-size // 2)
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash")))
        pairs = level.groupBy(F.floor(F.col("pos") / 2).cast("bigint").alias("pos")).agg(left.alias("l"), right.alias("r"))
        node = F.sha2(F.concat(F.lit(b"\1"), F.unhex("l"), F.unhex("r")), 256)
        level = cut(pairs.select(F.lit(n).alias("level"), "pos", F.when(F.col("r").isNull(), F.col("l")).otherwise(node).alias("hash")))
        out = out.unionByName(level)
    return out


def merkle_root(levels: DataFrame) -> DataFrame:
    return levels.groupBy().agg(F.max(F.struct("level", "hash")).alias("m"), F.count_if(F.col("level") == 0).alias("n_leaves")).select(
        F.coalesce("m.hash", F.sha2(F.lit(b""), 256)).alias("root"), "n_leaves"
    )


def merkle_proofs(levels: DataFrame, positions: DataFrame) -> DataFrame:
    """pos, proof: for each leaf position the siblings from below, as structs (level, left, hash)."""
    depth = levels.groupBy().agg(F.max("level").alias("depth"))
    wanted = positions.select("pos").join(F.broadcast(depth))  # one row
    steps = wanted.where("depth > 0").select("pos", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level"))
    steps = steps.withColumn("at", F.expr("shiftright(pos, level)"))
    steps = steps.withColumn("sibling", F.col("at").bitwiseXOR(F.lit(1).cast("bigint")))
    nodes = levels.select("level", F.col("pos").alias("sibling"), "hash")
    found = steps.join(nodes, ["level", "sibling"]).select("pos", F.struct("level", (F.col("sibling") % 2 == 0).alias("left"), "hash").alias("s"))
    return found.groupBy("pos").agg(F.array_sort(F.collect_list("s")).alias("proof"))


def proof_root(leaf_hash: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(h, s):
        return F.when(s["left"], F.sha2(F.concat(F.lit(b"\1"), F.unhex(s["hash"]), F.unhex(h)), 256)).otherwise(F.sha2(F.concat(F.lit(b"\1"), F.unhex(h), F.unhex(s["hash"])), 256))
    return F.aggregate(proof, leaf_hash, up)


def offsets(parts: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """Adds offset: the sum of the sizes before, in order, within the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def overlaps(ranges: DataFrame, extents: DataFrame, on: list[str], extent: int) -> DataFrame:
    """Ranges (start, stop) x extents (idx) that they touch: the range names its extents, then an equi join."""
    named = ranges.where("stop > start").withColumn("idx", F.explode(F.sequence(F.floor(F.col("start") / extent).cast("bigint"), F.floor((F.col("stop") - 1) / extent).cast("bigint"))))
    return named.join(extents, [*on, "idx"])


def compared(base: DataFrame, now: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status: VERIFIED, MODIFIED, FAILED (gone) or UNKNOWN (new)."""
    both = base.select(path, F.col(digest).alias("_a"), F.lit(1).alias("_in_a")).join(now.select(path, F.col(digest).alias("_b"), F.lit(1).alias("_in_b")), path, "full_outer")
    status = F.when(F.col("_in_b").isNull(), "FAILED").when(F.col("_in_a").isNull(), "UNKNOWN").when(F.col("_a").eqNullSafe(F.col("_b")), "VERIFIED").otherwise("MODIFIED")
    return both.select(path, status.alias("status"))


def verify_chunks(table: DataFrame, recovered: DataFrame) -> DataFrame:
    """idx, verified: recovered bytes (idx, data) against the chunk table (idx, chunk_id)."""
    return table.join(recovered, "idx", "left").select("idx", F.coalesce(F.sha2("data", 256) == F.col("chunk_id"), F.lit(False)).alias("verified"))


def publishable(refs: DataFrame, verified: DataFrame, file_id: str) -> DataFrame:
    """Files whose every chunk verified; nothing else is published."""
    return refs.join(verified, "idx", "left").groupBy(file_id).agg(F.bool_and(F.coalesce("verified", F.lit(False))).alias("ok")).where("ok").select(file_id)


def validate_chunks(table: DataFrame, start: int = 0) -> DataFrame:
    """One row: chunks, chunks whose predecessor in the index is missing, and chunks that do not begin where it ends
    (none does whose predecessor is missing).

    Numbers begin at 0 and offsets at ``start``. Each chunk meets the one before it by an equi join on the number, so
    the check needs no order over the whole table. Repeated numbers count as breaks once for each pair that does not fit.
    """
    before = table.select((F.col("idx") + 1).alias("idx"), (F.col("offset") + F.col("stored")).alias("_end"))
    rows = table.select("idx", "offset").join(before, "idx", "left")
    first = F.col("idx") == 0
    gap, end = ~first & F.col("_end").isNull(), F.when(first, F.lit(start)).otherwise(F.col("_end"))
    return rows.agg(F.count_distinct("idx").alias("n_chunks"), F.count_if(gap).alias("n_gaps"), F.count_if(gap | (F.col("offset") != end)).alias("n_breaks"))
