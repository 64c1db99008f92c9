"""A corpus pipeline: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame that is written as Parquet and read again by the next stage. All but
the last return the columns of ``documents``.

1. quality_rules drops what the base rule or the learned decision list rejects.
2. exact_dedup keeps the first of equal texts.
3. near_dedup keeps one document of each group that SimHash links (fingerprints of
   three-word shingles within two bits, as in op5_simhash) and links of texts with a
   five-word similarity of 0.8 connect.
4. pii masks personal data in the texts (n_chars follows the new text).
5. packing returns the place of every piece in the packed sequences.

Defined results, stage by stage: a null text counts as empty, so 1 rejects it (it
has no fifty words) and, given to the others alone, 2 and 3 take it for a copy of
an empty one, 4 leaves it null, 5 packs its closing id. Of ties (equal texts, or
near copies) the smallest id stays, a null id only if there is no other; rows that
repeat id and text are one document to 2 and 3. Texts of any length pass whole.
Empty tables, and tables that a stage has emptied, give empty results. Columns
beyond those of documents, whatever their names, are kept up to 4.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, near_copies, packing, pii, quality_rules
from strandlake.llm._shared import prepare, table

#: Tokenizing, models and group searches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    learned = quality_rules.learn(quality_rules.labelled(docs, table(spark, sf_dir, "labels")))
    return quality_rules.keep(docs, learned)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_copies.one_of_each(docs, radius=None, simhash_words=3)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    columns = docs.columns
    out = pii.redact(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
