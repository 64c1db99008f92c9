"""Small formats as Spark expressions: sizes, versions, paths, stamps, documents, sweep points, alignments (P22, P30, F12, F13, T10, C14, M19, M28, M29 rows)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes: powers of 1,024 with or without an "i".
UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
MAX_PATH_BYTES = 4096


def size_bytes(text: Column) -> Column:
    """Bytes of "64MiB", "1.5 kb" or "300"; null for anything else."""
    plain = F.replace(F.upper(F.trim(text)), F.lit("IB"), F.lit("B"))
    number, unit = (F.regexp_extract(plain, r"^([0-9]+\.?[0-9]*|\.[0-9]+)\s*([KMGT]?B)?$", i) for i in (1, 2))
    factor = F.lit(1)
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.when(number != "", F.floor(number.try_cast("double") * factor).cast("bigint"))


def version_key(version: Column) -> Column:
    """A struct that orders versions "1.10.2-rc1": numbers by value, a release after its pre-releases; null if not a version."""
    core = F.regexp_extract(version, r"^[0-9]+(?:\.[0-9]+)*(?=$|[-+])", 0)
    numbers = F.transform(F.split(core, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(core != "", F.struct(numbers.alias("numbers"), (~F.contains(version, F.lit("-"))).alias("release")))


def path_fault(path: Column) -> Column:
    """Why an archive refuses a path (length, unsafe, component, control); null if it does not. Paths are relative, with "/"."""
    n = F.octet_length(F.coalesce(path, F.lit("")))
    parts = F.split(path, "/", -1)
    return (
        F.when((n == 0) | (n > MAX_PATH_BYTES), "length").when(path.startswith("/") | F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\0")), "unsafe")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "component").when(path.rlike(r"[\x01-\x1F]"), "control")
    )


def utc_stamp(text: Column) -> Column:
    """The time of "2024-01-31T23:59:59Z" (fractions allowed); null for anything else."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$")
    return F.when(shape, F.try_to_timestamp(text))


def canonical_map(entries: Column) -> Column:
    """Canonical text of a map of strings: keys in order, no white space, so that equal maps have equal digests."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def canonical(document) -> str:
    """Canonical JSON of a document: keys in order, no white space, nothing that JSON does not know."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_document(raw: str, depth: int = 64, nodes: int = 4_000_000, longest: int = 1 << 20):
    """The document of a JSON text; ValueError for repeated keys, constants that JSON lacks, and what goes beyond the limits."""
    def unique(pairs):
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("a key is repeated")
        if any(len(k) > longest for k in found):
            raise ValueError("a key is too long")
        return found

    def refuse(name):
        raise ValueError(f"{name} is not allowed")

    try:
        out = json.loads(raw, object_pairs_hook=unique, parse_constant=refuse)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level, count, deep = [out], 0, 0
    while level:
        count += len(level)
        if count > nodes:
            raise ValueError("too many values")
        if any(isinstance(x, str) and len(x) > longest for x in level):
            raise ValueError("a text is too long")
        if deep >= depth and any(isinstance(x, dict | list) for x in level):
            raise ValueError("nested too deeply")
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]
        deep += 1
    return out


def path_value(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text."""
    return F.get_json_object(document, "$." + path)


def with_value(document: dict, path: str, value) -> dict:
    """A copy of the document with the value at a dotted path replaced; KeyError if the path is not there."""
    first, _, rest = path.partition(".")
    if first not in document:
        raise KeyError(path)
    return document | {first: with_value(document[first], rest, value) if rest else value}


def sweep_points(spec: Column) -> Column:
    """Points of "type=0.1,0.2" (one a rate) or "mixed=a:0.1+b:0.2" (one in all): an array of arrays of (name, rate).

    Null if the text is neither, or a rate is no probability.
    """
    name, values = F.lower(F.trim(F.substring_index(spec, "=", 1))), F.substring(spec, F.instr(spec, "=") + 1, F.lit(1 << 20))
    one = lambda n, r: F.struct(n.alias("name"), F.trim(r).try_cast("double").alias("rate"))
    mixed = F.array(F.transform(F.split(values, r"\+"), lambda x: one(F.lower(F.trim(F.substring_index(x, ":", 1))), F.substring_index(x, ":", -1))))
    listed = F.transform(F.split(values, ","), lambda x: F.array(one(name, x)))
    points = F.when(name == "mixed", mixed).otherwise(listed)
    fine = F.contains(spec, F.lit("=")) & F.forall(F.flatten(points), lambda p: F.coalesce(p["rate"].between(0, 1), F.lit(False)) & (p["name"] != ""))
    return F.when(fine, points)


def cigar_runs(cigar: Column) -> Column:
    """Runs of an alignment "12=1X3I": an array of (op, n)."""
    pattern = F.lit(r"([0-9]+)([=XIDMNSHP])")
    return F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"), F.transform(F.regexp_extract_all(cigar, pattern, F.lit(1)), lambda x: x.cast("int")).alias("n"))


def cigar_length(runs: Column, ops: str) -> Column:
    """Summed length of the runs of the given operations."""
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + F.when(r["op"].isin(*ops), r["n"]).otherwise(0))


def human_size(n: float) -> str:
    """The largest unit of which ``n`` bytes are one or more."""
    k = min(4, int(math.log(max(n, 1), 1024)))
    return f"{n / 1024**k:g}{list(UNITS)[k]}"
