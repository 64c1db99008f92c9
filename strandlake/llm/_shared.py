"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile

import strandlake
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it (Java and Python regex syntax).
SPACE = r"[\x20\x09-\x0D]+"

#: Most rows and bytes of a table that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000
#: Bits of the sieve before a semi join (8 MB), a power of two.
SIEVE_BITS = 1 << 26
#: Rows of a file of narrow rows.
ROWS_A_FILE = 100_000
#: Rows and bytes of a batch for Python workers.
BATCH_ROWS, BATCH_BYTES = 4096, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path Spark can read."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, bound their batches and give the session a checkpoint folder.

    Batch sizes that were set for the session stay. The folder named in
    spark.checkpoint.dir is used; only a local session without one (as in tests)
    gets a temporary folder. On a cluster without one this fails, because a
    machine's own folder is not seen by the others.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(strandlake.__file__)))
    path = sc.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    for key, default, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandlake-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    ``rows``: about how many it has, where that is known; then each file gets up to ``ROWS_A_FILE`` of them
    instead of every shuffle partition a file of its own.
    """
    prepare(df.sparkSession)
    return (df if rows is None else df.coalesce(files_for(rows))).checkpoint()


def files_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_FILE))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, whatever the optimizer collapses."""
    return F.transform(F.array(value), use)[0]


def small(keys: DataFrame) -> bool:
    """Whether a key table (already cut; numbers and hashes of up to 16 bytes) is small enough to broadcast."""
    return keys.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // (16 * len(keys.columns)))


def having(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``: broadcast if ``keys`` is small, else
    a shuffle join that stands alone in its stage, so that AQE can split hot keys."""
    if small(keys):
        return df.join(F.broadcast(keys), on, "left_semi")
    return df.join(keys, on, "left_semi").hint("rebalance")


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marked(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with ``_maybe``: false only for keys that are not in ``keys``, true for all that are and for few others while
    ``keys`` has far fewer than ``SIEVE_BITS`` rows. What is broadcast never exceeds those bits, however many keys there are."""
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    part, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    own = {n: free(df, n) for n in ("_part", "_bits")}
    sieve = keys.select(part.alias(own["_part"]), at.alias("_at")).groupBy(own["_part"]).agg(F.bitmap_construct_agg("_at").alias(own["_bits"]))
    byte = F.conv(F.hex(F.substring(own["_bits"], (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(own["_part"], part).join(F.broadcast(sieve), own["_part"], "left").select(*names, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def sifted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return marked(df, keys, on).where("_maybe").drop("_maybe")


def matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (already cut), alike at every size: a bounded sieve before the shuffle, then a
    semi join that stands alone in its stage, so that AQE can split hot keys."""
    return sifted(df, keys, on).join(keys, on, "left_semi").hint("rebalance")


def attach(df: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Left join of ``groups`` (one row a key): broadcast if small, else a shuffle join."""
    if small(groups):
        return df.join(F.broadcast(groups), on, "left")
    return df.join(groups, on, "left")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(id_column: str = "doc_id") -> Column:
    """The CRC-32 of the id as text, modulo 3; rows with 1 are held out from learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(3))
