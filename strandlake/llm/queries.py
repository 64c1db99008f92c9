"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, packing, pii, quality_qda, quality_rules, repeats, simhash, token_count, url_filter
from ._shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("full_hash", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled(docs, table(spark, sf_dir, "labels")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.judged(docs, rules).select("doc_id", *[F.col(f"stats.{n}").alias(n) for n in names], "base_failed", "kept")


def queries() -> dict:
    found = (op1_packing, op2_token_count, op3_pii, op4_exact_dedup, op5_simhash, op6_quality_qda, op7_repeats, op8_url_filter, op9_byte_bpe, op10_quality_rules)
    return {f.__name__: f for f in found}


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _op8_sql() -> str:
    terms = url_filter.read_terms()
    soft = " + ".join(f"CAST({_hit(t)} AS INT)" for t, _, w in terms if w < url_filter.STRICT_WEIGHT)
    strict = " + ".join(f"len(regexp_extract_all(u2, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t, _, w in terms if w >= url_filter.STRICT_WEIGHT)
    fits = []
    for what, host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{what} {host}{path}'")
    a, b = url_filter.UPPER, url_filter.LOWER
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), '{a}', '{b}') AS u,
                  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{a}', '{b}') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     q AS (SELECT *, regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g') AS u2, CASE {' '.join(fits)} END AS r FROM p),
     h AS (SELECT *, {strict} AS n_strict, {soft} AS n_soft FROM q)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule,
       CASE WHEN r IS NOT NULL THEN split_part(r, ' ', 1) WHEN n_strict >= 1 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS INT) AS n_strict, CAST(n_soft AS INT) AS n_soft
FROM h
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    return {"op4_exact_dedup": OP4_SQL, "op8_url_filter": _op8_sql()}
