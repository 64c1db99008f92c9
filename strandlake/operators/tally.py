"""Alignment events of reads and the rates that they show (A10, A14, M16, M19-M21, P24, W12 rows)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import alignment, frames

EVENT = "kind string, site int, ref_letters string, read_letters string"


def aligned(pairs: DataFrame, key: list[str], ref: str, read: str, band: int | None = 32, shift: str = "left") -> DataFrame:
    """key, distance, cigar, events of each pair; distance is null where no path stays within ``band``.

    ``shift`` left or right places ambiguous gaps. Row by row, without a shuffle.
    """
    n = len(key)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("site", pa.int32()), ("ref_letters", pa.string()), ("read_letters", pa.string())]))

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            refs, reads = ([t or "" for t in b.column(i).to_pylist()] for i in (n, n + 1))
            all_found = [alignment.align(x, y) for x, y in zip(refs, reads, strict=True)] if band is None else alignment.align_many(refs, reads, band)
            for x, y, found in zip(refs, reads, all_found, strict=True):
                if found is None:
                    row = (None, None, None)
                else:
                    runs = (alignment.leftmost if shift == "left" else alignment.rightmost)(x, y, found[1])
                    names = ("kind", "site", "ref_letters", "read_letters")
                    row = (found[0], alignment.cigar(runs), [dict(zip(names, e, strict=True)) for e in alignment.events(x, y, runs)])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], kind)], names=[*key, "distance", "cigar", "events"])

    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key)
    return pairs.select(*key, ref, read).mapInArrow(run, f"{types}, distance int, cigar string, events array<struct<{EVENT.replace(' string', ':string').replace(' int', ':int')}>>")


def blocks(found: DataFrame, key: list[str]) -> DataFrame:
    """key, block, idx, cnt: substitutions by letters, deletions and insertions by length, in long form."""
    rows = found.select(*key, F.explode("events").alias("e"))
    block = F.col("e.kind")
    idx = F.when(block == "substitution", F.concat_ws(">", "e.ref_letters", "e.read_letters")).otherwise(F.length(F.concat("e.ref_letters", "e.read_letters")).cast("string"))
    return rows.groupBy(*key, block.alias("block"), idx.alias("idx")).agg(F.count("*").alias("cnt"))


def composition(data: Column, most: int = 1 << 22) -> Column:
    """n_bases, n_gc, longest_run of the bases of each row's bytes (null: none), without writing the bases out."""
    @F.arrow_udf("struct<n_bases:bigint,n_gc:bigint,longest_run:bigint>")
    def measured(values: pa.Array) -> pa.Array:
        parts: list[tuple] = []
        values = values.fill_null(b"")
        sizes = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(values):  # a bounded number of bytes at a time
            base = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, base + most, side="right")))
            own = values.slice(first, last - first)
            offsets = np.concatenate([[0], sizes[first:last] - base])
            start = int(np.frombuffer(own.buffers()[1], np.int32)[own.offset])
            body = own.buffers()[2]
            data = np.frombuffer(body, np.uint8)[start : start + int(offsets[-1])] if body is not None else np.zeros(0, np.uint8)
            parts.append((4 * np.diff(offsets), *frames.composition(data, offsets)))
            first = last
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["n_bases", "n_gc", "longest_run"])

    return measured(data)


def estimates(tallies: DataFrame, sites: DataFrame, by: list[str], z: float = 1.959963984540054) -> DataFrame:
    """by, block, n_events, n_sites, rate, low, high: events a site with their Wilson bounds."""
    from ..functions.statistics import wilson

    sums = tallies.groupBy(*by, "block").agg(F.sum("cnt").alias("n_events")).join(sites.select(*by, "n_sites"), by)
    low, high = wilson(F.col("n_events"), F.col("n_sites"), z)
    return sums.withColumns({"rate": F.when(F.col("n_sites") > 0, F.col("n_events") / F.col("n_sites")).otherwise(F.lit(0.0)), "low": low, "high": high})


def run_lengths(tallies: DataFrame, by: list[str], block: str) -> DataFrame:
    """by, n, mean, geometric: runs of a block, their mean length and the rate of the geometric distribution that fits it."""
    rows = tallies.where(F.col("block") == block)
    size = F.col("idx").cast("bigint")
    out = rows.groupBy(*by).agg(F.sum("cnt").alias("n"), (F.sum(size * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    return out.withColumn("geometric", 1 / F.col("mean"))


def contexts(seqs: DataFrame, by: list[str], seq: str = "seq", k: int = 3) -> DataFrame:
    """by, context, n: how often each word of ``k`` letters occurs. Each batch sends one row a word and group."""
    n = len(by)

    def run(batches):
        for b in batches:
            sums: Counter = Counter()
            for row, s in enumerate(b.column(n).to_pylist()):
                own = tuple(b.column(i)[row].as_py() for i in range(n))
                codes = np.searchsorted(_LETTERS, np.frombuffer((s or "").encode("ascii", "replace"), np.uint8))
                known = np.isin(np.frombuffer((s or "").encode("ascii", "replace"), np.uint8), _LETTERS)
                if len(codes) < k:
                    continue
                at = sum(codes[i : len(codes) - k + 1 + i] * 4 ** (k - 1 - i) for i in range(k))
                fine = np.all([known[i : len(codes) - k + 1 + i] for i in range(k)], axis=0)
                counts = np.bincount(at[fine], minlength=4**k)
                for c in np.flatnonzero(counts):
                    sums[own, int(c)] += int(counts[c])
            rows = [(*own, "".join("ACGT"[c >> 2 * (k - 1 - i) & 3] for i in range(k)), v) for (own, c), v in sums.items()]
            kinds = [b.schema.field(i).type for i in range(n)] + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*by, "context", "n"])

    types = ", ".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in by)
    part = seqs.select(*by, seq).mapInArrow(run, f"{types}, context string, n bigint")
    return part.groupBy(*by, "context").agg(F.sum("n").alias("n"))


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
