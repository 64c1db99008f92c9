"""Removal of byte strings of a given width that occur more than once in a corpus.

A byte goes if it is covered by a string of ``width`` bytes that starts anywhere
else too, in the same document or another, judged on the input.

A suffix order of the whole corpus, column by column, would take as many passes
over all bytes as the longest document is long. The corpus is therefore cut into
short strings between which no repeated window can hide:

1. Each window of ``width`` bytes has an anchor: its 32-byte gram of least hash,
   the first such. Equal windows have equal anchors at equal places. Neighbouring
   windows with one anchor are one context (at most 2 * width - 32 bytes).
   Contexts are found in one pass over the texts and written.
2. Contexts are counted by (anchor, content hash). All windows of a context that
   occurs twice are repeated; no bytes need to be read again.
3. Where an anchor has several contexts, one copy of each is fetched and its
   windows are dealt into classes of ``STEP`` neighbouring starts. All windows of a
   class contain the same core of width - STEP + 1 bytes; a core of one context
   alone has no repeats.
4. With the core as one symbol the others are strings of at most 2 * STEP - 1
   symbols, and column_bwt builds their transform and common prefixes through
   sequential files; rows that share STEP symbols with a neighbour are repeated
   windows. A task takes whole cores of up to ``crowd`` strings; the windows of a
   core with more (all of it would meet in one task) are counted one by one.

Anchors, contexts and cores are compared by 64-bit hashes, each within the group
that the one before it gives; crowded windows by 128 bits.

``n_shared`` tells of passages that are shorter in bytes: of each 51 words in a
row the 26-word gram of least hash is chosen, and a document's chosen grams that
another document chose too are counted. Documents that share 51 words (with the
white space between them) share such a gram; those that share fewer than 26 don't.

Defined results: null texts are empty; texts shorter than ``width`` lose
nothing. Rows that repeat id and text are two texts, so all their windows repeat,
but one document to ``n_shared``. Empty tables give empty results; extra columns,
whatever their names, are ignored. Texts of any length are judged whole; a
document's runs meet in one task, as its text does.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, marked, matching, sifted
from .column_bwt import repeated_windows
from .components import written

WIDTH, GRAM = 400, 32
#: Words of a passage and of its grams.
PASSAGE, WORDS = 51, 26
#: Neighbouring windows that share a core.
STEP = 24
#: Bytes or words hashed at once; strings in one transform; strings of a core up to which it goes to a transform; contexts in a row.
BLOCK, COLLECTION, CROWD, PART = 1 << 20, 4_000, 2_000, 50_000
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(sums: np.ndarray, down: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``first`` up to ``last``."""
    h = (sums[last] - sums[first]) * down[first]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + 1) * up[:-1], out=sums[1:])
    return sums, down


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least gram (the first such) of each ``span`` in a row."""
    n = len(grams) - span + 1
    padded = np.full(-(-len(grams) // span) * span, np.iinfo(np.uint64).max)
    padded[: len(grams)] = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    table = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def contexts(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, place of the anchor, first window and last window of the text's contexts."""
    out = []
    for s in range(0, len(data) - width + 1, BLOCK):
        x = np.frombuffer(data, np.uint8, min(len(data) - s, BLOCK + width - 1), s)
        sums, down = _sums(x)
        starts = np.arange(len(x) - GRAM + 1)
        grams = _mixed(sums, down, starts, starts + GRAM)
        at = _least(grams, width - GRAM + 1)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        lasts = np.append(firsts[1:], len(at)) - 1
        out.append((grams[at[firsts]].view(np.int64), s + at[firsts], s + firsts, s + lasts))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def passages(data: bytes, words: int = PASSAGE, gram: int = WORDS) -> np.ndarray:
    """Hashes of the chosen grams of words, each once."""
    x = np.frombuffer(data, np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) < words:
        return np.zeros(0, np.int64)
    found = []
    for s in range(0, len(starts) - words + 1, BLOCK):
        own = slice(s, min(len(starts), s + BLOCK + words - 1))
        a, b = starts[own], ends[own]
        sums, down = _sums(x[a[0] : b[-1]])
        grams = _mixed(sums, down, a[: len(a) - gram + 1] - a[0], b[gram - 1 :] - a[0])
        found.append(grams[np.unique(_least(grams, words - gram + 1))])
    return np.unique(np.concatenate(found)).view(np.int64)


def _doc(id_column: str, text: str) -> Column:
    """A 128-bit key of id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def classes(anchor: int, at: int, lo: int, hi: int, width: int, step: int = STEP) -> list[tuple[int, int, int]]:
    """(class, first window, last window) of a context's windows."""
    return [(c, max(lo, at - step * c - step + 1), min(hi, at - step * c)) for c in range((at - hi) // step, (at - lo) // step + 1)]


_CONTEXT = pa.struct([("anchor", pa.int64()), ("ctx", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _found(docs: DataFrame, width: int) -> DataFrame:
    """doc, contexts, grams of every row of ``docs`` (doc, text); further rows hold what ``PART`` contexts don't."""
    def lists(values: pa.Array, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            cols: list[list] = [[np.zeros(0, np.int64)] for _ in range(5)]
            hashes, of, sizes, counts = array("Q"), [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                found = contexts(data, width) if len(data) >= width else cols[0][:1] * 4
                hashes.extend([xxh64_intdigest(data[lo:hi]) for lo, hi in zip(found[2].tolist(), (found[3] + width).tolist(), strict=True)])
                grams = passages(data)
                for c, v in zip(cols, (*found, grams), strict=True):
                    c.append(v)
                n = len(found[0])
                parts = [min(PART, n - i) for i in range(0, n, PART)] or [0]
                of += [row] * len(parts)
                sizes += parts
                counts += [len(grams)] + [0] * (len(parts) - 1)
            anchor, at, lo, hi, grams = map(np.concatenate, cols)
            parts = [pa.array(anchor), pa.array(np.frombuffer(hashes, np.int64)), *(pa.array(c.astype(np.int32)) for c in (at, lo, hi))]
            rows = [b.column(0).take(pa.array(of, pa.int32())), lists(pa.StructArray.from_arrays(parts, fields=list(_CONTEXT)), sizes), lists(pa.array(grams), counts)]
            yield pa.RecordBatch.from_arrays(rows, names=["doc", "contexts", "grams"])

    return docs.select("doc", "text").mapInArrow(run, "doc binary, contexts array<struct<anchor:bigint,ctx:bigint,at:int,lo:int,hi:int>>, grams array<bigint>")


def _strings(docs: DataFrame, wanted: DataFrame, width: int, n: int) -> DataFrame:
    """core, doc, first, left, right (bytes beside the core) of the classes of at most ``n`` ``wanted`` contexts (doc, anchor, at, lo, hi)."""
    lists = cut(wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("parts")), n)
    schema = pa.schema([("core", pa.int64()), ("doc", pa.binary()), ("first", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text, parts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "replace")
                for p in parts:
                    salt = p["anchor"] & 0xFFFFFFFFFFFF
                    for c, first, last in classes(p["anchor"], p["at"], p["lo"], p["hi"], width):
                        at = p["at"] - STEP * c
                        end = at - STEP + 1 + width
                        for col, v in zip(cols, (_signed(xxh64_intdigest(data[at:end], salt + c)), doc, first, data[first:at], data[end : last + width]), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    near = sifted(docs.select("doc", "text"), lists, ["doc"]).join(lists, "doc").select("doc", "text", "parts")
    return near.mapInArrow(run, "core bigint, doc binary, first int, left binary, right binary")


def _by_transform(parts: DataFrame, width: int, n: int) -> DataFrame:
    """doc, start, end of repeated windows among about ``n`` strings that lie together by core; their number, not their
    bytes, makes the work, so it sets the number of tasks."""
    def flush(rows):
        strings, last, group = [], None, 256
        for core, _, _, left, right in rows:
            group, last = group + (core != last), core
            s = np.empty(len(left) + 1 + len(right), np.uint16)
            s[: len(left)] = np.frombuffer(left, np.uint8)
            s[len(left) + 1 :] = np.frombuffer(right, np.uint8)
            s += 1
            s[len(left)] = group
            strings.append(s)
        for (_, doc, first, _, _), hits in zip(rows, repeated_windows(strings, STEP), strict=True):
            for a, b in hits:
                yield doc, first + a, first + b + width

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["doc", "start", "end"])

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            done = []
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if len(rows) >= COLLECTION and row[0] != rows[-1][0]:
                    done += flush(rows)
                    rows = []
                rows.append(row)
            yield batch(done)
        if rows:
            yield batch(list(flush(rows)))

    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // COLLECTION))
    near = parts.select("core", "doc", "first", "left", "right").repartition(tasks, "core").sortWithinPartitions("core")
    return near.mapInArrow(run, "doc binary, start int, end int")


def _by_rows(parts: DataFrame, width: int, n: int) -> DataFrame:
    """The same for ``n`` strings of crowded cores: one row a window, counted by content."""
    def run(batches):
        from xxhash import xxh128_digest

        for b in batches:
            cols: list[list] = [[], [], []]
            for core, doc, first, left, right in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for p in range(len(left) + len(right) - STEP + 2):
                    key = b"%d %d " % (core, len(left) - p) + left[p:] + right[: p + STEP - 1 - len(left)]
                    for c, v in zip(cols, (xxh128_digest(key), doc, first + p), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["window", "doc", "start"])

    rows = parts.select("core", "doc", "first", "left", "right").mapInArrow(run, "window binary, doc binary, start int")
    twice = cut(rows.groupBy("window").count().where("count > 1").select("window"), n * STEP // 2)
    return matching(rows, twice, ["window"]).select("doc", "start", (F.col("start") + width).alias("end"))


def spans(docs: DataFrame, found: DataFrame, n: int, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc, start, end (bytes) of what is repeated, unmerged; ``docs``: doc, text (not null); ``found``: as _found gives, with ``n`` contexts.

    Narrow tables are written in files by their number of rows, and what only filters one of them is not written again:
    without native Hadoop libraries a JVM starts two processes for the permissions of every local file."""
    rows = found.select("doc", F.explode("contexts").alias("c")).select("doc", "c.*")
    kinds = cut(rows.groupBy("anchor", "ctx").agg(F.count("*").alias("n")), n)
    twice = kinds.where("n > 1").select("anchor", "ctx")
    whole = matching(rows, twice, ["anchor", "ctx"]).select("doc", F.col("lo").alias("start"), (F.col("hi") + width).alias("end"))
    shared = cut(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), n // 2)
    one = matching(rows, shared, ["anchor"]).groupBy("anchor", "ctx").agg(F.min(F.struct("doc", "at", "lo", "hi")).alias("one"))
    strings = written(_strings(docs, one.select("one.*", "anchor"), width, n))
    cores = cut(strings.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core", "k", (F.col("k") > crowd).alias("crowded")), strings.count() // 2)
    sums = [F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)) for c in (~F.col("crowded"), F.col("crowded"))]
    n_few, n_crowded = cores.agg(*sums).first()
    out = whole.unionByName(_by_transform(matching(strings, cores.where("NOT crowded").select("core"), ["core"]), width, n_few))
    if not n_crowded:
        return out
    return out.unionByName(_by_rows(matching(strings, cores.where("crowded").select("core"), ["core"]), width, n_crowded))


def shared_grams(found: DataFrame, n: int) -> DataFrame:
    """doc, n_shared of documents with grams that another document has too; ``found`` has ``n`` grams."""
    rows = found.where(F.size("grams") > 0).select("doc", "grams").dropDuplicates(["doc"]).select("doc", F.explode("grams").alias("gram"))
    twice = cut(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), n // 2)
    return matching(rows, twice, ["gram"]).groupBy("doc").agg(F.count("*").alias("n_shared"))


def without_repeats(df: DataFrame, width: int = WIDTH, crowd: int = CROWD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary), n_shared of every row."""
    return _apply(df, width, crowd, id_column, text, "kept binary", lambda kept: kept, pa.binary())


def digests(df: DataFrame, width: int = WIDTH, crowd: int = CROWD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``without_repeats``, with kept_sha256 instead of the bytes."""
    return _apply(df, width, crowd, id_column, text, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest(), pa.string())


def merged(found: DataFrame) -> DataFrame:
    """doc, found: the maximal runs of each document's spans (doc, start, end), in order. Only runs are put in a list."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > before)).cast("int")
    rows = found.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("doc", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))


def _apply(df, width, crowd, id_column, text, last, of, last_type) -> DataFrame:
    docs = df.select(F.col(f"`{id_column}`").alias("id"), _doc(id_column, text).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = written(_found(docs, width))
    n, n_grams = found.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in ("contexts", "grams")]).first()
    lists = cut(merged(spans(docs, found, n, width, crowd).distinct()).join(shared_grams(found, n_grams), "doc", "full"), n + n_grams)
    names = [id_column, "n_bytes", "n_removed", "n_spans", last.split()[0], "n_shared"]

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = t.encode("utf-8", "replace")
                runs = [(f["start"], f["end"]) for f in found or ()]
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                for r, v in zip(rows, (len(data), len(data) - len(kept), len(runs), of(kept)), strict=True):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), last_type), strict=True)), b.column(3)], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    asked = marked(docs, lists, ["doc"])  # texts without repeats are not shuffled
    wide = asked.where("_maybe").join(lists, "doc", "left").select("id", "text", "found", F.coalesce("n_shared", F.lit(0)).alias("n"))
    plain = asked.where("NOT _maybe").select("id", "text", F.lit(None).cast(wide.schema["found"].dataType).alias("found"), F.lit(0).cast("long").alias("n"))
    whole = wide.unionByName(plain)
    return whole.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, {last}, n_shared long")
