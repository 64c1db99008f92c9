"""Sequences of the letters A, C, G, T as Spark expressions (P, F1 and W2 rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
HEX = "0123456789ABCDEF"
_LOW = "abcdefghijklmnop"


def pair(digit: int) -> str:
    """The two bases of a hexadecimal digit, most significant first."""
    return BASES[digit >> 2] + BASES[digit & 3]


def from_bytes(data: Column) -> Column:
    """Four bases a byte. Digits become lower-case marks first, which no base can be mistaken for."""
    out = F.translate(F.hex(data), HEX, _LOW)
    for i, mark in enumerate(_LOW):
        out = F.replace(out, F.lit(mark), F.lit(pair(i)))
    return out


def to_bytes(seq: Column) -> Column:
    """Inverse of ``from_bytes``; null for other letters or lengths."""
    out = F.regexp_replace(seq, "(..)", "$1,")
    for i, digit in enumerate(HEX):
        out = F.replace(out, F.lit(pair(i) + ","), F.lit(digit.lower() if digit in BASES else digit))
    return F.when(seq.rlike("^([ACGT]{4})*$"), F.unhex(out))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def gc(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def longest_run(seq: Column) -> Column:
    runs = F.regexp_extract_all(seq, F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def pieces(seq: Column, size: int) -> Column:
    """Array of consecutive pieces of ``size`` letters (the last may be shorter)."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def gc_outside(seq: Column, low: int = 40, high: int = 60) -> Column:
    """Whether the GC share is outside [low, high] percent, in whole numbers."""
    n = F.length(seq)
    return (100 * gc(seq) < low * n) | (100 * gc(seq) > high * n)


def run_over(seq: Column, most: int = 4) -> Column:
    return seq.rlike("|".join(f"{b}{{{most + 1}}}" for b in BASES))


def tandem_over(seq: Column, period: int, most: int) -> Column:
    """Whether a unit of ``period`` letters repeats so that most - period + 1 neighbouring letters equal their shift."""
    n = most - period + 1
    whole, rest = divmod(n, period)
    if not rest:
        return seq.rlike(f"(.{{{period}}})\\1{{{whole}}}")
    return seq.rlike(f"((.{{{rest}}}).{{{period - rest}}})\\1{{{whole}}}\\2")


def holds_motif(seq: Column, motifs: list[str], both_strands: bool = True) -> Column:
    table = str.maketrans("ACGT", "TGCA")
    words = sorted({*motifs, *(m.translate(table)[::-1] for m in motifs if both_strands)})
    return seq.rlike("|".join(words)) if words else F.lit(False)


def windows_outside(seq: Column, width: int, low: int, high: int) -> Column:
    """Number of windows of ``width`` letters whose GC share is outside; 0 for shorter sequences."""
    counts = F.transform(F.sequence(F.lit(1), F.length(seq) - width + 1), lambda i: gc(F.substring(seq, i, F.lit(width))))
    bad = F.filter(counts, lambda c: (100 * c < low * width) | (100 * c > high * width))
    return F.when(F.length(seq) >= width, F.size(bad)).otherwise(0)


def kmers(seq: Column, k: int) -> Column:
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def hash60(value: Column) -> Column:
    """The first 60 bits of the MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")


def minimizers(seq: Column, k: int = 12, w: int = 8) -> Column:
    """Distinct least hashes of each w neighbouring k-mers."""
    hashes = F.transform(kmers(seq, k), lambda x: hash60(canonical(x)))
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hashes) - w + 1)), lambda i: F.array_min(F.slice(hashes, i, F.lit(w))))
    return F.array_sort(F.array_distinct(F.filter(least, lambda x: x.isNotNull())))
