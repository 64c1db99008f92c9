"""Near copies for corpora: min-hash bands of five-word shingles, checked on the shingles themselves.

1. every text has 63 min-hashes of its five-word shingles; texts that agree in
   all three of one of 21 bands meet in a bucket (a pair with similarity 0.8
   meets with probability 0.9999997, whatever its single words are);
2. buckets of up to ``FEW`` texts give all pairs; members of larger ones are first
   compared with one leader;
3. pairs too far apart by set size or by their agreeing min-hashes go (one with
   similarity 0.8 in ten million does); the others are decided by the exact
   similarity of their whole shingle sets;
4. in larger buckets every pair of members that the links so far leave in
   different groups is compared as well, in blocks of ``BLOCK`` members;
5. with ``simhash_words``, SimHash fingerprints of shingles of so many words link as
   in ``simhash``: within two bits, found by its covering tables, whatever the
   five-word similarity is;
6. of each connected group, over the links of both kinds, the document with the
   smallest id stays.

The work of step 4 grows with the square of the members of a bucket only where
they stay in different groups; members of one group are not compared again.

Defined results: null texts are empty; empty texts are copies of each other;
texts of fewer than five words are one shingle; ASCII case does not count. Texts
of any length are compared whole. A null id is larger than any other; of equal ids
with different texts any one stays. Rows that repeat id and text are one document
and share its fate. Empty tables give empty results; extra columns, whatever their
names, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, having, small
from .components import components, written
from .simhash import SEED, edges, fingerprint, signed

#: RADIUS: most bits by which word fingerprints of a pair differ; the pipeline gives None, where only the similarity decides.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 4
#: Members up to which a bucket gives all pairs; bands and min-hashes of each; equal ones that a pair needs; members of a block.
FEW, BANDS, WIDTH, NEEDED, BLOCK = 16, 21, 3, 32, 256
HASHES = BANDS * WIDTH
_ODD = np.random.default_rng(SEED).integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x94D049BB133111EB)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").lower().split()
    joined = (b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1)))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _key(id_column: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _sketch(sets: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of all bands and the low byte of each min-hash."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(sets), 512):
        mixed = sets[None, at : at + 512] * _ODD[:, None]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, mixed.min(1), out=least)
    bands = least.reshape(BANDS, WIDTH)
    keys = np.zeros(BANDS, np.uint64)
    for i in range(WIDTH):
        keys = (keys ^ bands[:, i]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64), least.astype(np.uint8).tobytes()


def _nodes(docs: DataFrame, radius: int | None, simhash_words: int | None) -> DataFrame:
    """id, doc, fp, sim, bands, mins, size of every row of ``docs`` (id, doc, text); fp is 0 without a radius, sim without ``simhash_words``."""
    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(2).to_pylist():
                s = shingles(t)
                both = (0 if w is None else signed(fingerprint(t, w)) for w in (None if radius is None else 1, simhash_words))
                for c, v in zip(cols, (*both, *_sketch(s), len(s)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32()), strict=True))], names=["id", "doc", "fp", "sim", "bands", "mins", "size"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, doc binary, fp bigint, sim bigint, bands array<bigint>, mins binary, size int")


def _pairs(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of buckets (t, key) of ``rows``, of larger ones those with the leader; rows of larger buckets)."""
    mixed = F.struct(F.xxhash64("node").alias("h"), F.col("node"))
    buckets = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.min(mixed).alias("leader")).where("n > 1"), n)
    two = buckets.where("n = 2").select("a", "b")
    lists = having(rows, buckets.where(f"n > 2 AND n <= {FEW}").select("t", "key"), ["t", "key"]).groupBy("t", "key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    some = lists.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.lit(FEW)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = cut(buckets.where(f"n > {FEW}").select("t", "key", F.col("leader.node").alias("a")), n // BANDS)
    crowd = cut(rows.join(F.broadcast(large) if small(large) else large, ["t", "key"]), n)
    stars = crowd.where("a != node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    return two.union(some).union(stars).distinct(), crowd.select("t", "key", "node")


def _near(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, radius: int | None, similar: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("fp", "mins", "size")])

    @F.arrow_udf("int")
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, HASHES) for c in (a, b))
        return pa.array((x == y).sum(1), pa.int32())

    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b"))
    if radius is not None:
        pairs = pairs.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)
    pairs = cut(pairs.where(equal("mins_a", "mins_b") >= NEEDED).select("a", "b"))

    def compare(group: pa.Table) -> pa.Table:
        centre, nodes_of, sets = group.column("a")[0].as_py(), group.column("node").to_pylist(), group.column("set")
        own = np.frombuffer(sets[nodes_of.index(centre)].as_py(), np.uint64)
        found = [n for i, n in enumerate(nodes_of) if n != centre and similarity(own, np.frombuffer(sets[i].as_py(), np.uint64)) >= similar]
        return pa.table({"a": pa.array([centre] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    # each first node goes with at most about BLOCK of its partners to one task, so that its set is sent once for all of them
    dealt = cut(pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "a"))
    members = dealt.select("a", F.pmod(F.xxhash64("b", F.lit(SEED)), "k").cast("int").alias("part"), F.col("b").alias("node"))
    centres = dealt.select("a", "k").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("a").alias("node"))
    rows = members.union(centres)
    sets = _sets(docs, cut(rows.select("node").distinct().join(nodes.select("node", "doc"), "node")))
    return rows.join(sets, "node").groupBy("a", "part").applyInArrow(compare, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, doc, already cut) with set: the bytes of the node's shingle hashes, one row a node."""
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())

    columns = [c for c in wanted.columns if c != "doc"]
    return docs.join(F.broadcast(wanted) if small(wanted) else wanted, "doc").select(*columns, packed("text").alias("set")).dropDuplicates(["node"])


def _halves(members: DataFrame) -> DataFrame:
    """``members`` (t, key, node, root) of buckets dealt into blocks: pair, side, node, root for each two blocks that hold several roots.

    A root with a block or more in its bucket has blocks of its own, which are not compared with each other.
    """
    spot = ["t", "key"]
    sizes = cut(members.groupBy(*spot, "root").count().withColumn("base", F.when(F.col("count") >= BLOCK, F.col("root")).otherwise(F.lit(-1))))
    blocks = cut(sizes.groupBy(*spot, "base").agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("k")))
    place = sizes.join(blocks, [*spot, "base"]).select(*spot, "root", "base", "k")
    dealt = members.join(F.broadcast(place) if small(cut(place)) else place, [*spot, "root"])
    dealt = dealt.select(*spot, "base", F.pmod(F.xxhash64("node", F.lit(SEED)), "k").alias("i"), "node", "root")
    every = cut(blocks.select(*spot, "base", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")))
    x, y = (every.select(*spot, F.struct("base", "i").alias(n)) for n in "xy")
    two = x.join(y, spot).where((F.col("x") <= F.col("y")) & ((F.col("x.base") != F.col("y.base")) | (F.col("x.base") < 0)))
    two = two.withColumn("pair", F.struct("t", "key", "x", "y"))
    sides = two.select(*spot, "pair", F.lit(0).alias("side"), "x.base", "x.i").union(two.where("x != y").select(*spot, "pair", F.lit(1), "y.base", "y.i"))
    return dealt.join(sides, [*spot, "base", "i"]).select("pair", "side", "node", "root")


def _resolve(crowd: DataFrame, found: DataFrame, docs: DataFrame, nodes: DataFrame, radius: int | None, similar: float) -> DataFrame | None:
    """Links for the buckets ``crowd`` (t, key, node) whose members ``found`` leaves in several groups; None if there are none.

    Each two members of different groups are compared, the more alike by min-hashes first; a pair goes
    without only if its groups have met through others of its two blocks.
    """
    roots = components(found, written) if not found.isEmpty() else found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    members = cut(crowd.join(roots, "node", "left").select("t", "key", "node", F.coalesce("root", "node").alias("root")))
    several = cut(members.groupBy("t", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("t", "key"))
    if several.isEmpty():
        return None
    halves = cut(_halves(cut(having(members, several, ["t", "key"]))))
    wanted = cut(halves.select("node").distinct().join(nodes.select("node", "doc", "fp", "mins"), "node"))

    sets = cut(_sets(docs, wanted))

    def compare(group: pa.Table) -> pa.Table:
        node, root, side, fp = (group[c].to_numpy() for c in ("node", "root", "side", "fp"))
        mins = np.frombuffer(b"".join(group["mins"].to_pylist()), np.uint8).reshape(-1, HASHES)
        own = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
        size = np.array([len(s) for s in own])
        up = {int(r): int(r) for r in root}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        alone = not len(right)
        if alone:
            right = left
        tried: list[tuple[np.ndarray, ...]] = []
        for n, i in enumerate(left):
            js = right[n + 1 :] if alone else right
            equal = (mins[js] == mins[i]).sum(1)
            good = (equal >= NEEDED) & (root[js] != root[i]) & (np.minimum(size[js], size[i]) >= similar * np.maximum(size[js], size[i]))
            if radius is not None:
                good &= np.bitwise_count((fp[js] ^ fp[i]).view(np.uint64)) <= radius
            tried.append((equal[good], np.full(good.sum(), i), js[good]))
        out = []
        if tried:
            equal, first, second = (np.concatenate(c) for c in zip(*tried, strict=True))
            for n in np.argsort(-equal, kind="stable"):
                i, j = int(first[n]), int(second[n])
                a, b = top(int(root[i])), top(int(root[j]))
                if a != b and similarity(own[i], own[j]) >= similar:
                    up[max(a, b)] = min(a, b)
                    out.append(sorted((int(node[i]), int(node[j]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return halves.join(sets, "node").groupBy("pair").applyInArrow(compare, "a bigint, b bigint")


def links(docs: DataFrame, nodes: DataFrame, radius: int | None = RADIUS, similar: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes that join all similar texts; ``docs``: doc, text; ``nodes``: node, doc, fp, bands, mins, size; ``radius`` None: any fingerprints."""
    n = BANDS * nodes.count()
    pairs, crowd = _pairs(cut(nodes.select("node", F.posexplode("bands").alias("t", "key")), n), n)
    found = cut(_near(pairs, docs, nodes, radius, similar))
    more = _resolve(crowd, found, docs, nodes, radius, similar)
    return found if more is None else found.union(more).distinct()

def one_of_each(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int | None = RADIUS, similar: float = SIMILARITY, simhash_words: int | None = None
) -> DataFrame:
    """The rows of ``df`` with one document of each group of near copies, all columns as they were.

    ``simhash_words``: what SimHash fingerprints of shingles of so many words link is a near copy as well; None: only similar texts are.
    """
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), _key(id_column, text).alias("_doc"))
    docs = df.select(F.col(id_column).alias("id"), _key(id_column, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes = cut(_nodes(docs, radius, simhash_words).dropDuplicates(["doc"]).withColumn("node", F.monotonically_increasing_id()), BANDS * df.count())
    found = links(docs.select("doc", "text"), nodes, radius, similar)
    if simhash_words is not None:
        found = found.union(edges(nodes.select("node", F.col("sim").alias("fp")))).distinct()
    found = cut(found)
    if found.isEmpty():
        return df
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("node"))
    member = cut(components(found, written).join(nodes.select("node", "id", "doc"), "node"))
    first = member.groupBy("root").agg(F.min(order).alias("first")).select("first.node")
    dropped = cut(member.join(first, "node", "left_anti").select(F.col("doc").alias("_doc")))
    left = keyed.join(F.broadcast(dropped) if small(dropped) else dropped, "_doc", "left_anti")
    return left.select("_row.*")
