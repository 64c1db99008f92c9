"""Archives end to end: chunk, dedup, compress, seal, Merkle root; verify; locate; selective retrieval (E1-E5, J9, D11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sealing
from ..operators import archive
from ..operators.common import cut, numbered

DOMAIN = 1


@dataclass
class Archive:
    """chunks: idx, offset, stored, plain, codec, stored_sha256, chunk_id, data; refs: file, pos, idx; files: file, size, sha256."""

    chunks: DataFrame
    refs: DataFrame
    files: DataFrame
    root: str


def _pieces(files: DataFrame, size: int) -> DataFrame:
    n = F.ceil(F.octet_length("data") / size)
    rows = files.select("file", "data", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))).alias("pos"))
    return rows.select("file", "pos", F.expr(f"substring(data, cast(pos * {size} + 1 as int), {size})").alias("data")).withColumn("chunk_id", F.sha2("data", 256))


def build(files: DataFrame, size: int = 65_536, key: bytes | None = None, archive_id: bytes = b"") -> Archive:
    """``files``: file (bigint), data (binary). Equal chunks are stored once; with a key they are sealed."""
    pieces = _pieces(files, size)
    firsts = pieces.groupBy("chunk_id").agg(F.min(F.struct("file", "pos", "data")).alias("first"))
    table = numbered(firsts.select("chunk_id", F.col("first.file").alias("_f"), F.col("first.pos").alias("_p"), F.col("first.data").alias("plain_data")), ["_f", "_p"]).drop("_f", "_p")
    packed = table.withColumn("_c", sealing.compress("plain_data")).select("idx", "chunk_id", F.octet_length("plain_data").cast("bigint").alias("plain"), F.col("_c.codec").alias("codec"), F.col("_c.data").alias("data"))
    if key is not None:
        packed = packed.withColumn("data", sealing.seal(F.col("data"), key, DOMAIN, F.col("idx"), archive_id))
    packed = cut(packed.withColumns({"stored": F.octet_length("data").cast("bigint"), "stored_sha256": F.sha2("data", 256)}))
    chunks = cut(with_offsets(packed))
    entry = F.concat_ws("|", "idx", "offset", "stored", "plain", F.col("codec").cast("string"), "stored_sha256", "chunk_id")
    root = archive.merkle_root(archive.merkle_levels(chunks.select(F.col("idx").alias("pos"), archive.leaf(entry.cast("binary")).alias("hash")))).first()["root"]
    refs = archive.references(pieces, chunks, "file")
    return Archive(chunks, refs, files.select("file", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256")), root)


def with_offsets(chunks: DataFrame, block: int = 100_000) -> DataFrame:
    """Running offsets by blocks of numbers: sums of blocks first, then within each block."""
    blocked = chunks.withColumn("_b", F.floor(F.col("idx") / block))
    sums = archive.offsets(blocked.groupBy("_b").agg(F.sum("stored").alias("_s")).withColumn("_k", F.lit(0)), ["_k"], ["_b"], "_s").select("_b", F.col("offset").alias("_before"))
    return archive.offsets(blocked.join(F.broadcast(sums), "_b"), ["_b"], ["idx"], "stored").withColumn("offset", F.col("offset") + F.col("_before")).drop("_b", "_before")


def opened(a: Archive, key: bytes | None = None, archive_id: bytes = b"") -> DataFrame:
    """idx, data, verified of every chunk: stored digest, authentication, size and content id all have to hold."""
    body = sealing.unseal(F.col("data"), key, DOMAIN, F.col("idx"), archive_id) if key is not None else F.col("data")
    plain = sealing.decompress("codec", "_body", "plain")
    rows = a.chunks.where(F.sha2("data", 256) == F.col("stored_sha256")).withColumn("_body", body).where(F.col("_body").isNotNull()).withColumn("_plain", plain)
    good = rows.where(F.sha2("_plain", 256) == F.col("chunk_id")).select("idx", F.col("_plain").alias("data"), F.lit(True).alias("verified"))
    return a.chunks.select("idx").join(good, "idx", "left").select("idx", "data", F.coalesce("verified", F.lit(False)).alias("verified"))


def extract(a: Archive, key: bytes | None = None, archive_id: bytes = b"", wanted: DataFrame | None = None) -> DataFrame:
    """file, data of the files whose every chunk and whole digest verify; ``wanted``: a table of files to restrict to."""
    refs = a.refs.join(wanted.select("file"), "file", "left_semi") if wanted is not None else a.refs
    files = a.files.join(wanted.select("file"), "file", "left_semi") if wanted is not None else a.files
    parts = refs.join(opened(a, key, archive_id), "idx")
    whole = parts.groupBy("file").agg(F.bool_and("verified").alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("h"))
    data = F.unhex(F.coalesce("h", F.lit("")))
    out = files.join(whole, "file", "left").withColumn("data", data)
    return out.where(F.coalesce("ok", F.lit(True)) & (F.sha2("data", 256) == F.col("sha256"))).select("file", "data")


def verify(a: Archive, key: bytes | None = None, archive_id: bytes = b"") -> DataFrame:
    """One row a check: name, ok."""
    table = archive.validate_chunks(a.chunks).select(F.explode(F.array(F.struct(F.lit("index").alias("name"), (F.col("n_gaps") == 0).alias("ok")), F.struct(F.lit("offsets").alias("name"), (F.col("n_breaks") == 0).alias("ok")))).alias("c")).select("c.*")
    entry = F.concat_ws("|", "idx", "offset", "stored", "plain", F.col("codec").cast("string"), "stored_sha256", "chunk_id")
    now = archive.merkle_root(archive.merkle_levels(a.chunks.select(F.col("idx").alias("pos"), archive.leaf(entry.cast("binary")).alias("hash"))))
    tree = now.select(F.lit("merkle").alias("name"), (F.col("root") == a.root).alias("ok"))
    bodies = opened(a, key, archive_id).agg(F.coalesce(F.bool_and("verified"), F.lit(True)).alias("ok")).select(F.lit("chunks").alias("name"), "ok")
    return table.unionByName(tree).unionByName(bodies)


def locate(a: Archive, wanted: DataFrame, k: int, payload: int) -> DataFrame:
    """file, idx, first_group, last_group: strand groups that hold each chunk's stored bytes."""
    span = k * payload
    rows = a.refs.join(wanted.select("file"), "file", "left_semi").join(a.chunks.select("idx", "offset", "stored"), "idx")
    return rows.select("file", "idx", F.floor(F.col("offset") / span).cast("bigint").alias("first_group"), F.floor((F.col("offset") + F.greatest("stored", F.lit(1)) - 1) / span).cast("bigint").alias("last_group")).distinct()


def needed_groups(located: DataFrame) -> DataFrame:
    """Groups to decode for the located chunks, each once."""
    return located.select(F.explode(F.sequence("first_group", "last_group")).alias("grp")).distinct()
