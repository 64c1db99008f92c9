"""URL filter: allow and block rules, then a weighted vocabulary.

Host rules come first (longest fitting rule wins). Other urls are judged by an
Aho-Corasick pass over the vocabulary's terms: a hit counts only between
boundaries (no ASCII letter or digit next to it). A strict term rejects alone;
soft terms reject once enough distinct ones are hit.

The vocabulary is a parameter: ``read_terms`` reads a file of classes, weights and
terms (the one beside this module by default); a weight of ``STRICT_WEIGHT`` makes
a term strict. It travels to the workers with the function, so its size is the
caller's; the automaton is built once a worker.

Defined results: a null url, or one without ``://``, has an empty host and
path; a null or empty url has no hits and is allowed unless a rule says otherwise.
Urls of any length are read whole. Repeated rows are judged alike; of rules with
equal lengths the later one wins; an empty table gives an empty result. Extra
columns, whatever their names, are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "url_terms.txt")
STRICT_WEIGHT = 2
SOFT_LIMIT = 2
#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=8)
def read_terms(path: str = TERMS) -> tuple[tuple[str, str, int], ...]:
    """(term, class, weight) of a vocabulary file, each term once: with its greatest weight."""
    best: dict[str, tuple[str, int]] = {}
    with open(path, encoding="ascii") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                kind, weight, *terms = line.split()
                for t in terms:
                    if t not in best or best[t][1] < int(weight):
                        best[t] = (kind, int(weight))
    return tuple((t, kind, weight) for t, (kind, weight) in sorted(best.items()))


@lru_cache(maxsize=8)
def automaton(terms: tuple[tuple[str, str, int], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, _, weight in terms:
        out.add_word(term, (term, weight >= STRICT_WEIGHT))
    out.make_automaton()
    return out


_FOLD = str.maketrans(UPPER, LOWER)


def hits(url: str | None, terms: tuple[tuple[str, str, int], ...]) -> tuple[int, int]:
    """(strict hits, distinct soft terms hit) between boundaries."""
    text = (url or "").translate(_FOLD)
    n, seen = 0, set()
    for end, (term, is_strict) in automaton(terms).iter(text) if terms else ():
        start = end - len(term)
        if (start < 0 or text[start] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
            if is_strict:
                n += 1
            else:
                seen.add(term)
    return n, len(seen)


def _counts(url: Column, terms: tuple[tuple[str, str, int], ...]) -> Column:
    @F.arrow_udf("struct<n_strict:int,n_soft:int>")
    def count(urls: pa.Array) -> pa.Array:
        found = [hits(u, terms) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], names=["n_strict", "n_soft"])

    return count(url)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judged(rows: DataFrame, rules, terms, soft_limit: int) -> DataFrame:
    """``rows`` (_carried, _url) with host, path, rule, verdict, n_strict, n_soft."""
    out = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url")), "_hits": _counts(F.col("_url"), terms)})
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends outermost
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits, verdict = F.when(fit, F.lit(host + path)).otherwise(fits), F.when(fit, F.lit(what)).otherwise(verdict)
    own = F.when((F.col("_hits.n_strict") >= 1) | (F.col("_hits.n_soft") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("_carried", "host", "path", fits.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "_hits.n_strict", "_hits.n_soft")


def judge(pages: DataFrame, id_column: str = "page_id", url: str = "url", rules=RULES, terms=None, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """id, host, path, rule, verdict, n_strict, n_soft of every row."""
    rows = pages.select(F.col(f"`{id_column}`").alias("_carried"), F.col(f"`{url}`").alias("_url"))
    return _judged(rows, rules, read_terms() if terms is None else tuple(terms), soft_limit).withColumnRenamed("_carried", id_column)


def keep(pages: DataFrame, url: str = "url", rules=RULES, terms=None, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """The rows of ``pages`` that are allowed, all columns as they were."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_carried"), F.col(f"`{url}`").alias("_url"))
    return _judged(rows, rules, read_terms() if terms is None else tuple(terms), soft_limit).where("verdict = 'allow'").select("_carried.*")
