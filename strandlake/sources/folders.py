"""A folder of files as a table, and archives as folders of tables (S10, S11, S14, S15, S17 rows)."""

from __future__ import annotations

import hashlib
import json
import uuid
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, path_fault, strict_document
from ..operators import archive
from ..operators.common import numbered
from ..plans.archives import Archive

FORMAT = "strandlake-archive/1"


def _empty_files(store, top, pattern: str) -> list[tuple[str, float]]:
    out, found = [], store.listFiles(top, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if not f.getLen() and fnmatchcase(name, pattern) and not name.startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getModificationTime() / 1000))
    return out


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, path (relative), size, modified, data of every file below ``folder``, numbered in the order of their paths.

    Any store that Spark reads will do. Spark's source leaves empty files out, so these are listed by the driver. A file whose bytes are not as many as the listing says (it changed meanwhile)
    has null data, and a path that an archive would refuse has a fault.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    root = store.makeQualified(top).toString().rstrip("/")
    if empty := _empty_files(store, top, pattern):
        none = spark.createDataFrame([(p, t) for p, t in empty], "path string, at double")
        rows = rows.select("path", "modificationTime", "length", "content").unionByName(
            none.select("path", F.col("at").cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"))
        )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the same file with one slash or three
    own = F.substring(plain(F.col("path")), F.length(plain(F.lit(root))) + 2, F.lit(1 << 20))
    whole = F.when(F.octet_length("content") == F.col("length"), F.col("content"))
    out = rows.select(own.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), whole.alias("data"))
    return numbered(out.withColumn("fault", path_fault(F.col("path"))), ["path"], "file").select("file", "path", "size", "modified", "data", "fault")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def save(a: Archive, folder: str) -> str:
    """Write an archive as tables with a manifest; the manifest is written last, so a folder without one is no archive.

    Returns the digest of the manifest.
    """
    spark = a.chunks.sparkSession
    part = uuid.uuid4().hex
    for name in ("chunks", "refs", "files"):
        getattr(a, name).write.parquet(f"{folder}/{name}-{part}")
    counts = {n: spark.read.parquet(f"{folder}/{n}-{part}").count() for n in ("chunks", "refs", "files")}
    text = canonical({"format": FORMAT, "part": part, "root": a.root, "counts": counts})
    _write_text(spark, f"{folder}/manifest.json", text)
    return hashlib.sha256(text.encode()).hexdigest()


def load(spark: SparkSession, folder: str, digest: str | None = None) -> Archive:
    """The archive of a folder; ValueError for a manifest that is not canonical, not the expected one, or does not fit its tables."""
    text = _read_text(spark, f"{folder}/manifest.json")
    if digest is not None and hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError("not the expected archive")
    m = strict_document(text)
    if canonical(m) != text or set(m) != {"format", "part", "root", "counts"} or m["format"] != FORMAT:
        raise ValueError("not a canonical manifest of this format")
    tables = {n: spark.read.parquet(f"{folder}/{n}-{m['part']}") for n in ("chunks", "refs", "files")}
    if {n: t.count() for n, t in tables.items()} != m["counts"]:
        raise ValueError("tables and manifest do not agree")
    checks = archive.validate_chunks(tables["chunks"]).first()
    if checks["n_gaps"] or checks["n_breaks"]:
        raise ValueError("the chunk table has gaps or breaks")
    return Archive(root=m["root"], **tables)


def write_clusters(clusters: DataFrame, folder: str) -> None:
    """Clusters (id, members, ...) as JSON lines between a header and a trailer record that tells their number."""
    spark = clusters.sparkSession
    clusters.select(F.to_json(F.struct(F.lit("cluster").alias("type"), *clusters.columns)).alias("value")).write.text(f"{folder}/clusters")
    n = spark.read.text(f"{folder}/clusters").count()
    _write_text(spark, f"{folder}/header.json", canonical({"type": "header", "schema": clusters.schema.simpleString()}))
    _write_text(spark, f"{folder}/trailer.json", canonical({"type": "end", "clusters": n}))


def read_clusters(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The clusters of a folder; ValueError where the trailer is missing or tells another number."""
    rows = spark.read.text(f"{folder}/clusters").select(F.from_json("value", f"type string, {schema}").alias("r")).where("r.type = 'cluster'")
    if json.loads(_read_text(spark, f"{folder}/trailer.json")) != {"type": "end", "clusters": rows.count()}:
        raise ValueError("the trailer does not fit the clusters")
    return rows.select("r.*").drop("type")


PRICES = "vendor string, per_order decimal(18,6), per_strand decimal(18,6), per_base decimal(18,6), max_nt int, min_order int"


def price_list(spark: SparkSession, path: str) -> DataFrame:
    """A price list (JSON lines) in exact decimals; ValueError if a price is missing or negative, or a vendor is there twice."""
    rows = spark.read.schema(PRICES).json(path)
    bad = rows.where("vendor IS NULL OR least(per_order, per_strand, per_base) < 0 OR per_order IS NULL OR per_strand IS NULL OR per_base IS NULL OR max_nt IS NULL OR min_order IS NULL")
    if not bad.isEmpty() or not rows.groupBy("vendor").count().where("count > 1").isEmpty():
        raise ValueError("a price list names each vendor once, with prices of zero or more")
    return rows
