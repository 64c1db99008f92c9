"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a
histogram with at most ``capacity`` counters, whatever the number of documents:
only it reaches the driver. There

1. the reduction fixes sets that dominate every alternative: a longest rest
   that nothing fits beside; an exact complement; the best partner where at most
   one (or, under the published condition, two) more fit. Each step fixes as
   many equal sets as the counters allow;
2. best-fit in decreasing order packs what remains, with equal bins kept as one
   group and a count.

The plan is a bounded list of intervals (length, first rank, last rank) ->
(bins, offset). Executors rank pieces within their length (partition counts
plus a running sum) and look their bin up; nothing else moves.

Defined results: a null text is empty; an empty text is one piece that holds
the closing id alone. Texts of any length are encoded whole. Rows that repeat an id
are packed each for itself; pieces of equal length are placed in the order of their
partitions. An empty table has no pieces. Extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import codec
from ._shared import attach, cut

CAPACITY = 2048
#: Id that closes each document.
CLOSING = 0


@dataclass
class Bins:
    """``count`` equal bins: their lengths in order, and the room left."""

    lengths: tuple[int, ...]
    count: int
    room: int


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Fix dominating sets; takes their pieces out of ``counts``."""
    fixed: list[Bins] = []

    def fix(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=len(counts))
        n = int(min(counts[x] // need[x] for x in set(lengths)))
        counts[:] -= n * need
        fixed.append(Bins(tuple(lengths), n, capacity - sum(lengths)))

    def smallest(n: int, above: int = 0) -> int:
        """Sum of the n smallest pieces longer than ``above``; beyond any capacity if fewer."""
        total = 0
        for x in np.flatnonzero(counts[above + 1 :])[:n] + above + 1:
            take = min(n, int(counts[x]))
            total, n = total + take * int(x), n - take
            if not n:
                return total
        return capacity + 1

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1
            present = np.flatnonzero(counts[: room + 1])
            one, two, three = smallest(1), smallest(2), smallest(3)
            pair = None
            if one <= room and two <= room < three:
                best = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
                for a in present[::-1].tolist():
                    counts[a] -= 1
                    b = int(best[room - a]) if room - a >= 1 else 0
                    if b and not counts[b]:  # a itself was the only one
                        below = np.flatnonzero(counts[:b])
                        b = int(below[-1]) if len(below) else 0
                    counts[a] += 1
                    if b and (pair is None or a + b > sum(pair)):
                        pair = (a, b)
                    if 2 * a < (sum(pair) if pair else 0):
                        break
            counts[j] += 1
            if one > room:
                fix(j)
                continue
            partner = int(present[-1])
            if partner == room or two > room:
                fix(j, partner)
            elif three > room and pair is not None:
                a, b = max(pair), min(pair)
                if partner >= a + b:
                    fix(j, partner)
                elif a == partner and smallest(2, b) > room:
                    fix(j, a, b)
                else:
                    break
            else:
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Best-fit decreasing of all that is in ``counts``, over groups of equal bins."""
    groups: dict[int, list[Bins]] = {}
    rooms: set[int] = set()
    full: list[Bins] = []

    def put(b: Bins) -> None:
        if b.count:
            if b.room:
                groups.setdefault(b.room, []).append(b)
                rooms.add(b.room)
            else:
                full.append(b)

    for x in range(capacity, 0, -1):
        n = int(counts[x])
        while n:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                each = capacity // x
                if n // each:
                    put(Bins((x,) * each, n // each, capacity - each * x))
                if n % each:
                    put(Bins((x,) * (n % each), 1, capacity - (n % each) * x))
                break
            b = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.discard(room)
            each = room // x
            whole = min(b.count, n // each)
            put(Bins(b.lengths + (x,) * each, whole, room - each * x))
            n -= whole * each
            rest = b.count - whole
            if rest and n and n < each:
                put(Bins(b.lengths + (x,) * n, 1, room - n * x))
                rest, n = rest - 1, 0
            put(Bins(b.lengths, rest, room))
    return full + [b for g in groups.values() for b in g]


def plan(counts: np.ndarray, capacity: int) -> tuple[list[Bins], int]:
    """All bins, and how many of them the reduction fixed."""
    left = np.array(counts, np.int64)
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity), sum(b.count for b in fixed)


def slots(bins: list[Bins]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """length -> (first ranks, (first bin, offset of the first, pieces a bin)) of each interval."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    base = 0
    for b in bins:
        at, offset = 0, 0
        while at < len(b.lengths):
            x, n = b.lengths[at], 1
            while at + n < len(b.lengths) and b.lengths[at + n] == x:
                n += 1
            ranks, places = out.setdefault(x, ([], []))
            ranks.append(used.get(x, 0))
            places.append((base, offset, n))
            used[x] = used.get(x, 0) + n * b.count
            at, offset = at + n, offset + n * x
        base += b.count
    return out


def pieces(df: DataFrame, path: str, pattern: str, capacity: int, id_column: str, text: str) -> DataFrame:
    """One row a piece, with _part and _rank: its rank among the partition's pieces of its length."""
    names = [id_column, "piece", "start", "length", "ids_crc32", "_part", "_rank"]

    def run(batches):
        c, part = codec(path, pattern), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            of, cols = array("q"), [array("q") for _ in range(5)]  # row of the id, then piece, start, length, crc, rank
            for row, found in enumerate(c.encode_all(b.column(1))):
                ids = np.append(found, np.uint32(CLOSING)).astype("<u4")
                start, end, k = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    n = end - start
                    of.append(row)
                    for col, v in zip(cols, (k, start, n, zlib.crc32(ids[start:end]), seen[n]), strict=True):
                        col.append(v)
                    seen[n] += 1
                    start, end, k = end, end + capacity, k + 1
            piece, start, length, crc, rank = (pa.array(np.frombuffer(x, np.int64)) for x in cols)
            place = pa.array(np.full(len(of), part, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.frombuffer(of, np.int64))), piece.cast(pa.int32()), start, length, crc, place, rank], names=names)

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def pack(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = cut(pieces(df, path, pattern, capacity, id_column, text))
    counts = cut(rows.groupBy("_part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[r["length"]] = r["n"]
    bins, _ = plan(histogram, capacity)
    where = slots(bins)

    running = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    ranked = attach(rows, cut(base), ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        seq, off = [], []
        for x, r in zip(lengths.to_pylist(), ranks.to_pylist(), strict=True):
            firsts, places = where[x]
            i = bisect_right(firsts, r) - 1
            b, o, n = places[i]
            q, m = divmod(r - firsts[i], n)
            seq.append(b + q)
            off.append(o + m * x)
        return pa.StructArray.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["s", "o"])

    at = F.arrow_udf(place, "struct<s:bigint,o:bigint>")
    return ranked.withColumn("_at", at("length", "_rank")).select(
        id_column, "piece", "start", "length", "ids_crc32", F.col("_at.s").alias("sequence_id"), F.col("_at.o").alias("offset")
    )
