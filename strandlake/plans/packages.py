"""Packages that a laboratory gets and gives back: content-addressed folders with sums (S18-S20, U7 rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, strict_document
from ..operators.pools import set_differences
from ..sources.folders import _read_text, _write_text

ORDER, RETURN = "strandlake-order/1", "strandlake-return/1"


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 of the files of a package, without its list."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -2)
    return rows.where(~F.col("path").rlike(r"/(package\.json|_SUCCESS|[._][^/]*)$")).select(name.alias("path"), F.sha2("content", 256).alias("sha256"))


def _close(spark: SparkSession, folder: str, kind: str, facts: dict) -> None:
    """Write the list of files; a package without it is not one."""
    _sums(spark, folder).orderBy("path").coalesce(1).write.json(f"{folder}/_sums")
    root = _sums(spark, folder).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "path")))), 256).alias("h")).first()["h"]
    _write_text(spark, f"{folder}/package.json", canonical({"kind": kind, "files": root} | facts))


def checked(spark: SparkSession, folder: str, kind: str) -> dict:
    """The facts of a package; ValueError if files are missing, changed or not listed, or if it is of another kind."""
    m = strict_document(_read_text(spark, f"{folder}/package.json"))
    if m.get("kind") != kind:
        raise ValueError(f"a package of the kind {m.get('kind')}")
    listed = spark.read.schema("path string, sha256 string").json(f"{folder}/_sums")
    bad = set_differences(listed, _sums(spark, folder), "path", "sha256").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['path']} {r['fault']}" for r in bad))
    return m


def order_sheet(strands: DataFrame, prefix: str = "strand") -> DataFrame:
    """well, name, seq, nt: one row a strand to be made, named by its address."""
    name = F.concat_ws("-", F.lit(prefix), "file", "grp", "symbol")
    return strands.select(name.alias("name"), "seq", F.length("seq").alias("nt"))


def write_order(strands: DataFrame, folder: str, longest: int, shortest: int = 1) -> dict:
    """Write an order; ValueError if a strand's length is not one that can be made or a letter is no base."""
    sheet = order_sheet(strands)
    bad = sheet.where(~F.col("nt").between(shortest, longest) | ~F.col("seq").rlike("^[ACGT]*$")).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['name']} can't be made")
    spark = strands.sparkSession
    sheet.write.option("header", "true").csv(f"{folder}/sheet")
    facts = {"strands": spark.read.option("header", "true").csv(f"{folder}/sheet").count()}
    _close(spark, folder, ORDER, facts)
    return facts


def read_order(spark: SparkSession, folder: str) -> DataFrame:
    m = checked(spark, folder, ORDER)
    rows = spark.read.schema("name string, seq string, nt int").option("header", "true").csv(f"{folder}/sheet")
    if rows.count() != m["strands"]:
        raise ValueError("the sheet has not as many strands as its list says")
    return rows


def write_return(reads: DataFrame, folder: str) -> dict:
    """Write reads (seq, qual) that came back."""
    spark = reads.sparkSession
    reads.select("seq", "qual").write.parquet(f"{folder}/reads")
    facts = {"reads": spark.read.parquet(f"{folder}/reads").count()}
    _close(spark, folder, RETURN, facts)
    return facts


def read_return(spark: SparkSession, folder: str) -> DataFrame:
    checked(spark, folder, RETURN)
    return spark.read.parquet(f"{folder}/reads")


class Provider:
    """What makes strands and reads them: ``make`` takes an order's folder, ``read`` gives a return's folder."""

    def __init__(self, name: str, longest: int, channel: Callable[[DataFrame], DataFrame]):
        self.name, self.longest, self.channel = name, longest, channel

    def fulfil(self, spark: SparkSession, order: str, back: str) -> dict:
        """The simulated provider: strands of an order through a channel (a function of strands) into a return."""
        sheet = read_order(spark, order)
        parts = F.split("name", "-")
        strands = sheet.select(F.get(parts, F.lit(1)).cast("bigint").alias("file"), F.get(parts, F.lit(2)).cast("bigint").alias("grp"), F.get(parts, F.lit(3)).cast("int").alias("symbol"), "seq")
        return write_return(self.channel(strands), back)
