"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Native: DataFrame functions only. Texts are equal when they are identical after
each run of white space became one space.

1. Group all rows by the byte length of the normalised text.
2. Rows whose length is not unique are grouped by the hash of a prefix.
3. Only rows that still share length and prefix get the hash of the whole text.

Rows travel as keys and ids; no text is shuffled. Counting is partial before
each shuffle, so a group that holds a third of all rows costs one row a task.

Defined results: a null text counts as empty; empty texts are equal to each
other. A null id counts as larger than any other. Of rows that repeat both id
and text one stays (the first in the order of the input's partitions). An empty
table gives an empty result. Extra columns are ignored by ``decisions`` and
kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, attach, cut, having, small

#: Characters of the normalised text that the second level hashes.
PREFIX = 512


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _order(id_column: str) -> Column:
    return F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"))


def _levels(df: DataFrame, text: str, prefix: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their length and prefix hash, keys that more than one row has, number of rows)."""
    n = df.count()
    rows = df.withColumn("_norm", normalised(F.col(text)))
    rows = rows.withColumn("_len", F.octet_length("_norm")).withColumn("_pre", F.xxhash64(F.substring("_norm", 1, prefix)))
    keys = rows.select("_len", "_pre")
    lengths = cut(keys.groupBy("_len").count().where("count > 1").select("_len"), n)
    pairs = cut(having(keys, lengths, ["_len"]).groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre"), n)
    return rows, pairs, n


def _hashed(rows: DataFrame, pairs: DataFrame, everything: bool) -> DataFrame:
    """Adds _full: the whole text's SHA-256 where length and prefix are shared, else null
    (with ``everything``: on all rows), and _shared."""
    full = F.sha2(F.col("_norm").cast("binary"), 256)
    if small(pairs):
        marked = rows.join(F.broadcast(pairs.withColumn("_shared", F.lit(True))), ["_len", "_pre"], "left")
        return marked.withColumn("_full", full if everything else F.when(F.col("_shared"), full))
    return rows.withColumn("_shared", F.lit(True)).withColumn("_full", full)


def decisions(df: DataFrame, id_column: str = "doc_id", text: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, full_hash.

    full_hash is null for rows that an earlier level proved unique, unless
    ``digest_all`` asks for everyone's.
    """
    rows, pairs, n = _levels(df.select(id_column, text), text, prefix)
    narrow = _hashed(rows, pairs, digest_all).select(
        F.col(id_column), "_len", "_pre", "_full", "_shared", F.monotonically_increasing_id().alias("_row")
    )
    narrow = cut(narrow)
    groups = (
        narrow.where("_shared")
        .groupBy("_len", "_pre", "_full")
        .agg(F.min(F.struct(_order(id_column).alias("key"), F.col("_row").alias("row"))).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    joined = attach(narrow, cut(groups, n), ["_len", "_pre", "_full"])
    return joined.select(
        F.col(id_column),
        F.when(F.col("_first").isNull(), F.col(id_column)).otherwise(F.col("_first.key.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_first").isNull() | (F.col("_first.row") == F.col("_row"))).alias("kept"),
        F.col("_full").alias("full_hash"),
    )


def drop_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``df`` without exact copies, all columns as they were (whatever their names)."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    rows, pairs, n = _levels(held, "_text", prefix)
    rows = _hashed(rows, pairs, False)
    counts = rows.where("_shared").groupBy("_len", "_pre", "_full", _order("_id").alias("_key")).agg(F.count("*").alias("_c"))
    groups = cut(
        counts.groupBy("_len", "_pre", "_full")
        .agg(F.min(F.struct("_key", "_c")).alias("_first"), F.sum("_c").alias("_n"))
        .where("_n > 1"),
        n,
    )
    left = attach(rows, groups, ["_len", "_pre", "_full"]).where(F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first._key.id")))
    if groups.where("_first._c > 1").isEmpty():
        return left.select("_row.*")
    again = F.coalesce(F.col("_first._c") > 1, F.lit(False))
    once = left.where(~again).select("_row")
    return once.unionByName(left.where(again).dropDuplicates(["_len", "_pre", "_full"]).select("_row")).select("_row.*")
