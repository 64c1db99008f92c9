"""Screening of sequences against constraint rules (F1, F2, F8, S9, A25 rows)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..kernels import frames
from ..kernels import screen as kernel


@dataclass(frozen=True)
class Rules:
    """Rules of the screen; None or empty switches a rule off."""

    gc: tuple[int, int] | None = (40, 60)
    window: tuple[int, int, int] | None = None  # width, low, high
    homopolymer: int | None = 4
    tandem: int | None = None
    motifs: tuple[str, ...] = field(default_factory=tuple)
    length: tuple[int, int] | None = None

    def columns(self, seq: Column) -> dict[str, Column]:
        """Violation of each rule; letters outside the alphabet always count."""
        out = {"invalid_base": ~seq.rlike("^[ACGTN]*$")}
        if self.gc:
            out["gc_content"] = S.gc_outside(seq, *self.gc)
        if self.window:
            out["gc_window"] = S.windows_outside(seq, *self.window) > 0
        if self.homopolymer is not None:
            out["homopolymer"] = S.run_over(seq, self.homopolymer)
        if self.tandem is not None:
            out["tandem_repeat"] = S.tandem_over(seq, 2, self.tandem) | S.tandem_over(seq, 3, self.tandem)
        if self.motifs:
            out["motif"] = S.holds_motif(seq, list(self.motifs))
        if self.length:
            out["length"] = ~F.length(seq).between(*self.length)
        return out


#: Letters screened at once.
MATRIX = 1 << 21
ORDER = ["gc_content", "gc_window", "homopolymer", "tandem_repeat", "motif", "length", "invalid_base"]


def screen(df: DataFrame, rules: Rules, seq: str = "seq") -> DataFrame:
    """Adds ``violations``: bit i is set where rule ORDER[i] is violated; null for a null sequence.

    Sequences of one length are screened together (``Rules.columns`` has the same rules as expressions).
    """
    @F.arrow_udf("int")
    def bits(values: pa.Array) -> pa.Array:
        plain = values.fill_null("")
        if not pc.all(pc.equal(pc.binary_length(plain), pc.utf8_length(plain))).as_py():
            plain = pa.array([s.encode("ascii", "replace").decode() for s in plain.to_pylist()], pa.string())
        sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.frombuffer("".join(plain.to_pylist()).encode(), np.uint8)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(len(sizes), np.int32)
        for length in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == length)
            step = max(1, MATRIX // max(1, length))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                found = kernel.violations(text[starts[part][:, None] + np.arange(length)], rules)
                out[part] = sum(found[n].astype(np.int32) << i for i, n in enumerate(ORDER) if n in found)
        return pa.array(out, pa.int32(), mask=values.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn("violations", bits(F.col(seq)))


def summary(screened: DataFrame, by: list[str]) -> DataFrame:
    """Strands, satisfied ones and violations of each rule per group."""
    per_rule = [F.sum(F.shiftright("violations", i).bitwiseAND(1)).cast("long").alias(f"n_{n}") for i, n in enumerate(ORDER)]
    return screened.groupBy(*by).agg(F.count("*").alias("n_strands"), F.count_if(F.col("violations") == 0).alias("n_satisfied"), *per_rule)


def strands(df: DataFrame, data: Column, nt: int, keys: list[str]) -> DataFrame:
    """One row per strand of ``nt`` letters of the encoded bytes: keys, pos, seq. Row by row, a bounded number of letters at a time."""
    n = len(keys)
    most = -(-MATRIX // (4 * nt)) * nt  # bytes at a time; whole strands, whatever nt is

    def built(b: pa.RecordBatch, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sizes = 4 * np.array([len(c) for *_, c in parts], np.int64)
        counts = -(-sizes // nt)
        each = np.repeat(np.arange(len(parts)), counts)
        number = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = (np.cumsum(sizes) - sizes)[each] + np.minimum((number + 1) * nt, sizes[each])
        letters = frames.LETTERS[np.frombuffer(b"".join(c for *_, c in parts), np.uint8)]
        seq = pa.StringArray.from_buffers(len(each), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(letters.tobytes()))
        rows, first = (np.array([p[i] for p in parts])[each] for i in (0, 1))
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rows)) for i in range(n)), pa.array(first // nt + number, pa.int32()), seq], names=[*keys, "pos", "seq"])

    def run(batches):
        for b in batches:
            held: list[tuple[int, int, bytes]] = []
            size = 0
            for row, value in enumerate(b.column(n)):
                content = value.as_py() or b""
                for at in range(0, len(content), most):
                    held.append((row, 4 * at, content[at : at + most]))
                    size += len(held[-1][2])
                    if size >= most:
                        yield built(b, held)
                        held, size = [], 0
            if held:
                yield built(b, held)

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, data.alias("_data")).mapInArrow(run, f"{types}, pos int, seq string")


def filtered(reads: DataFrame, shortest: int, longest: int, quality: float | None = None, seq: str = "seq") -> DataFrame:
    """Reads within the length bounds and, if given, with the least mean quality (column qual_mean)."""
    out = reads.where(F.length(seq).between(shortest, longest))
    return out.where(F.col("qual_mean") >= quality) if quality is not None else out


def read_statistics(reads: DataFrame, shortest: int, longest: int, seq: str = "seq") -> DataFrame:
    """One row: reads, kept, too short, too long, unknown bases of kept, and total bases kept."""
    n = F.length(seq)
    ok = n.between(shortest, longest)
    return reads.agg(
        F.count("*").alias("n_reads"), F.count_if(ok).alias("n_kept"), F.count_if(n < shortest).alias("n_short"), F.count_if(n > longest).alias("n_long"),
        F.sum(F.when(ok, n).otherwise(0)).cast("long").alias("bases_kept"), F.sum(F.when(ok, n - F.length(F.translate(seq, "N", ""))).otherwise(0)).cast("long").alias("n_unknown"),
    )


def lengths(reads: DataFrame, seq: str = "seq") -> DataFrame:
    return reads.groupBy(F.length(seq).alias("len")).agg(F.count("*").alias("n"))


def top_lengths(reads: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    return lengths(reads, seq).orderBy(F.desc("n"), "len").limit(k)


def masked_by_quality(seq: Column, errors: Column, least: int) -> Column:
    """Letters whose quality (array) is below ``least`` become N."""
    letters = F.zip_with(F.split(seq, ""), errors, lambda b, q: F.when(q < least, F.lit("N")).otherwise(b))
    return F.array_join(letters, "")
