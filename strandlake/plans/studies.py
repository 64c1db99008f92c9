"""Studies: manifests, runs, repetition, cached results, comparisons (O3, O4, O7, E8 rows)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators.experiments import differences, trial_seed

#: Fields of a study's manifest and their kinds.
FIELDS = {"name": str, "version": str, "seed": int, "trials": int, "parameters": dict, "deterministic": list}


def faults(manifest: dict) -> list[str]:
    """What keeps a manifest from being run; empty if nothing does."""
    out = [f"{n} is missing" for n in FIELDS if n not in manifest] + [f"{n} is not known" for n in manifest if n not in FIELDS]
    out += [f"{n} is no {k.__name__}" for n, k in FIELDS.items() if n in manifest and (not isinstance(manifest[n], k) or isinstance(manifest[n], bool))]
    if out:
        return out
    if manifest["trials"] < 1:
        out.append("trials is less than one")
    out += [f"parameter {n} has no values" for n, v in manifest["parameters"].items() if not isinstance(v, list) or not v]
    return out + ([] if manifest["deterministic"] else ["nothing is said to be deterministic"])


def manifest_hash(manifest: dict) -> str:
    return hashlib.sha256(canonical(manifest).encode()).hexdigest()


def trials(spark: SparkSession, manifest: dict) -> DataFrame:
    """point, trial, seed and the parameters of every trial: the grid of all values, each point ``trials`` times."""
    if bad := faults(manifest):
        raise ValueError("; ".join(bad))
    rows = spark.range(1).select(F.lit("").alias("point"))
    for name, values in sorted(manifest["parameters"].items()):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
        rows = rows.withColumn("point", F.concat("point", F.lit(f"{name}="), F.col(name).cast("string"), F.lit(";")))
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(manifest["trials"] - 1))))
    return rows.withColumn("seed", trial_seed(F.lit(manifest["seed"]), F.col("point"), F.col("trial")))


def run(spark: SparkSession, manifest: dict, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The trials with what ``measure`` adds, marked with the manifest's hash."""
    return measure(trials(spark, manifest)).withColumn("manifest", F.lit(manifest_hash(manifest)))


def reproduced(recorded: DataFrame, observed: DataFrame, manifest: dict) -> DataFrame:
    """point, trial, field, recorded, observed where a deterministic field came out otherwise (or a trial is missing)."""
    def long(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in manifest["deterministic"]])
        return df.select("point", "trial", F.explode(pairs).alias("x")).select("point", "trial", "x.field", "x.value")

    return differences(long(recorded), long(observed), ["point", "trial", "field"], "value")


def compared(results: DataFrame, by: list[str], variant: str, a: str, b: str, measure: str) -> DataFrame:
    """by, n_a, n_b, mean_a, mean_b, ratio of two variants of a study (rule sets, versions)."""
    side = lambda v: F.col(variant) == v
    out = results.groupBy(*by).agg(
        F.count_if(side(a)).alias("n_a"), F.count_if(side(b)).alias("n_b"), F.avg(F.when(side(a), F.col(measure))).alias("mean_a"), F.avg(F.when(side(b), F.col(measure))).alias("mean_b")
    )
    return out.withColumn("ratio", F.col("mean_a") / F.nullif("mean_b", F.lit(0.0)))


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(result, whether it was there): a table kept under the hash of its canonical key (inputs' digests and options).

    A table counts only once Spark has committed it; two writers of one key write the same rows.
    """
    path = f"{folder}/{hashlib.sha256(canonical(key).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if there := done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path), there
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False
