"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has bit j set when more than half of the text's word shingles have
bit j set in their XXH64. Fingerprints link when at most two bits differ (the radius).

Covering LSH: each bit position gets a vector of radius + 1 bits; for each of the
2^(radius+1) - 1 non-zero vectors v, a table masks out all positions whose vector
is orthogonal to v. The vectors of ``radius`` positions never span the whole
space, so some v leaves all differing positions out: every pair within the
radius meets in some table.

Equal fingerprints are one node. Of a bucket with two nodes the pair is checked.
Nodes of larger buckets are linked exactly without listing pairs: for radius 2,
two fingerprints are within 2 bits if and only if a third one is within 1 bit of
both, so each node names its 65 neighbours and itself, and nodes that name the
same one are linked to the smallest (at most 65 share one, by construction).
``masks`` gives the tables of any radius; linking is for radius 2.

Defined results: null and empty texts have fingerprint 0 and link like any
other; a text of fewer words than a shingle is one shingle; words repeat as
often as they occur. A null id takes part, but a component's id is null only if
all its ids are. Texts of any length are hashed whole. Repeated rows get the same
result; an empty table gives an empty result. Extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import attach, cut, small
from .components import components

BITS, SEED = 64, 42
#: Shingles hashed at once, which bounds memory for very long texts.
CHUNK = 1 << 18


def fingerprint(text: str, words: int) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, words: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (bigint: the fingerprint's bits) of every row."""
    def run(batches):
        for b in batches:
            fp = [signed(fingerprint(t or "", words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=[id_column, "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, fp bigint")


def masks(radius: int) -> list[int]:
    """Bits that each table keeps; every set of ``radius`` positions is left out by some table.

    Positions get the vectors 1, 2, ... in turn, so that tables keep about as many bits each.
    """
    space = 1 << (radius + 1)
    of = [1 + i % (space - 1) for i in range(BITS)]
    return [sum(1 << i for i, v in enumerate(of) if (v & t).bit_count() & 1) for t in range(1, space)]


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _flips() -> Column:
    """The fingerprint and its 64 neighbours at one bit."""
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])


def _links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what is within 2 bits, among distinct fingerprints ``fp``."""
    n = nodes.count()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(2))])
    rows = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    buckets = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), 7 * n)  # as many as there are rows to read
    pairs = buckets.where("n = 2").select("a", "b").where(_far("a", "b") <= 2)
    crowd = cut(rows.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct(), 7 * n)
    near = crowd.select("fp", F.explode(_flips()).alias("mid"))
    stars = near.groupBy("mid").agg(F.collect_list("fp").alias("all"), F.min("fp").alias("a")).where(F.size("all") > 1)
    return pairs.union(stars.select("a", F.explode("all").alias("b")).where("a != b")).distinct()


def edges(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect exactly the nodes whose fingerprints link; ``nodes``: node, fp (already cut), one row a node."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")), nodes.count())
    copies = first.where("n > 1").select("fp", "a")
    equal = nodes.join(F.broadcast(copies) if small(copies) else copies, "fp").where("a != node").select("a", F.col("node").alias("b"))
    near = cut(_links(first.select("fp")))
    for name in "ab":
        near = near.join(first.select(F.col("fp").alias(name), F.col("a").alias(f"node_{name}")), name)
    return equal.union(near.select(F.least("node_a", "node_b"), F.greatest("node_a", "node_b")))


def classes(df: DataFrame, words: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (bigint), component_id, n_copies (rows with the same fingerprint) of every row."""
    rows = cut(fingerprints(df, words, id_column, text))
    n = rows.count()
    nodes = cut(rows.groupBy("fp").agg(F.min(id_column).alias("first"), F.count("*").alias("n_copies")), n)
    labels = components(_links(nodes)).withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(labels, "fp", "left").select("fp", "first", "n_copies", F.coalesce("root", "fp").alias("root")), n)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(rooted.join(least, "root").select("fp", "component_id", "n_copies"), n)
    return attach(rows, of, ["fp"]).select(id_column, "fp", "component_id", "n_copies")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
