"""Outcomes, sweeps, tallies, intervals (O rows, A10-A16, A23-A28, W13-W14, F10, F14 rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import mcnemar, wilson
from .common import cut, numbered


def outcome(crash: Column, wrong: Column, status: Column, exit_code: Column, published: Column) -> Column:
    """Class of a decode: crash, then wrong bytes, then what the status claims, checked for consistency.

    status null is a typed error; ``published``: number of published files.
    """
    success = F.when(exit_code != 0, "CRASH").when(published == 0, "CRASH").otherwise("EXACT")
    failure = F.when(published > 0, "CRASH").when(status.isNull() & (exit_code == 0), "CRASH").otherwise("EXPLICIT_FAILURE")
    return F.when(crash, "CRASH").when(wrong, "FALSE_SUCCESS").when(status == "SUCCESS", success).when(status == "PARTIAL", "PARTIAL").otherwise(failure)


def wrong_names(truth: DataFrame, published: DataFrame, run: str, name: str, digest: str) -> DataFrame:
    """run, names: published files that differ from the truth or are not in it."""
    both = published.join(truth.select(run, name, F.col(digest).alias("_truth")), [run, name], "left")
    return both.where(~F.col(digest).eqNullSafe(F.col("_truth"))).groupBy(run).agg(F.array_sort(F.collect_list(name)).alias("names"))


OUTCOMES = ["EXACT", "PARTIAL", "EXPLICIT_FAILURE", "FALSE_SUCCESS", "CRASH"]


def curve(trials: DataFrame, point: list[str], result: str, seconds: str, kinds: list[str], success: str) -> DataFrame:
    """point, count of each outcome, n, success rate with its Wilson bounds, median seconds (exact)."""
    counts = [F.count_if(F.col(result) == k).alias(f"n_{k.lower()}") for k in kinds]
    hits = F.count_if(F.col(result) == success)
    low, high = wilson(hits, F.count("*"))
    return trials.groupBy(*point).agg(F.count("*").alias("n"), *counts, (hits / F.count("*")).alias("rate"), low.alias("low"), high.alias("high"), F.percentile(seconds, 0.5).alias("median_seconds"))


def summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (0 for one value), min, max."""
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


def holm(tests: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Adds adjusted: Holm's step-down p-values of each family."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(*family))
    stepped = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tests.withColumn("_s", stepped).withColumn("adjusted", F.max("_s").over(running)).drop("_s")


def paired_ratio(base: DataFrame, new: DataFrame, by: list[str], seed: list[str], seconds: str) -> DataFrame:
    """by, n_pairs, ratio: geometric mean of base / new over paired runs."""
    both = base.select(*by, *seed, F.col(seconds).alias("_a")).join(new.select(*by, *seed, F.col(seconds).alias("_b")), [*by, *seed])
    return both.where("_a > 0 AND _b > 0").groupBy(*by).agg(F.count("*").alias("n_pairs"), F.exp(F.avg(F.ln(F.col("_a") / F.col("_b")))).alias("ratio"))


def discordant(runs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, b, c, p: discordant pairs and their exact McNemar p-value."""
    out = runs.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    return out.withColumn("p", mcnemar(F.col("b"), F.col("c")))


def histogram(values: DataFrame, by: list[str], value: str, width: float, bins: int) -> DataFrame:
    """by, bin, n: counts in ``bins`` bins, the ends clamped."""
    index = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) / width))).cast("int")
    return values.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))


def tally(events: DataFrame, ref: str, block: str, idx: str) -> DataFrame:
    """ref, block, idx, cnt in long form: integer counts, so sums do not depend on partitions."""
    return events.groupBy(ref, block, idx).agg(F.count("*").alias("cnt"))


def bootstrap_weights(refs: DataFrame, ref: str, replicates: int) -> DataFrame:
    """ref, b, w: how often each of the n references is drawn in replicate b, n draws each (with replacement).

    Draw i of replicate b takes the reference whose number is a hash of (b, i) modulo n: the same anywhere, and the
    multiplicities of a replicate sum to n.
    """
    placed = cut(numbered(refs.select(ref).distinct(), [ref], "_number"))
    n = placed.count()
    if not n:
        return refs.select(ref, F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("w"))
    draws = placed.select(F.col("_number").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("_i").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    drawn = draws.select("b", (h % n).alias("_number")).groupBy("b", "_number").agg(F.count("*").alias("w"))
    return drawn.join(placed, "_number").select(ref, "b", "w")


def bootstrap_totals(tallies: DataFrame, weights: DataFrame, ref: str) -> DataFrame:
    """b, block, idx, total: weighted sums over references; replicates are joined by reference."""
    return tallies.join(weights, ref).groupBy("b", "block", "idx").agg(F.sum(F.col("w") * F.col("cnt")).cast("bigint").alias("total"))


def interval(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, low, high: the 2.5 and 97.5 percentiles (linear)."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*by).agg(p.alias("_p")).select(*by, F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def ks_distance(values: DataFrame, by: list[str], value: str, sample: str, a: str, b: str) -> DataFrame:
    """by, ks: the largest distance of the two samples' distribution functions, from counts per distinct value."""
    counts = values.where(F.col(sample).isin(a, b)).groupBy(*by, value).agg(F.count_if(F.col(sample) == a).alias("_a"), F.count_if(F.col(sample) == b).alias("_b"))
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    share = lambda c: F.sum(c).over(running) / F.sum(c).over(whole)
    return counts.withColumn("_d", F.abs(share("_a") - share("_b"))).groupBy(*by).agg(F.max("_d").alias("ks"))


def total_variation(values: DataFrame, by: list[str], value: str, sample: str, a: str, b: str) -> DataFrame:
    counts = values.groupBy(*by, value).agg(F.count_if(F.col(sample) == a).alias("_a"), F.count_if(F.col(sample) == b).alias("_b"))
    totals = counts.groupBy(*by).agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    return counts.join(totals, by).groupBy(*by).agg((F.sum(F.abs(F.col("_a") / F.col("_ta") - F.col("_b") / F.col("_tb"))) / 2).alias("tv"))


def differences(recorded: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, recorded, observed where they differ or one is absent."""
    both = recorded.select(*keys, F.col(value).alias("recorded")).join(observed.select(*keys, F.col(value).alias("observed")), keys, "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("observed")))


def grid(points: dict[str, DataFrame]) -> DataFrame:
    """All combinations of small parameter tables (a sweep's grid)."""
    frames = list(points.values())
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def trial_seed(base: Column, point: Column, trial: Column) -> Column:
    """The first 56 bits of SHA-256("base|point|trial")."""
    text = F.concat_ws("|", base.cast("string"), point.cast("string"), trial.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 14), 16, 10).cast("bigint")


def exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of metric samples (name, labels map, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return metrics.select(F.concat("name", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("line"))


def alerts(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """name, labels, value, alert of samples for which a rule (name -> SQL predicate) holds."""
    named = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in rules.items()]))
    return metrics.withColumn("alert", F.explode(named))


def counters(rows: DataFrame, by: list[str], name: str, n: str) -> DataFrame:
    """by, name, n: counters of workers and batches added up; Spark sums within tasks first."""
    return rows.groupBy(*by, name).agg(F.sum(n).cast("bigint").alias("n"))


def realised_rates(counts: DataFrame, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """``counts`` with each rate (name -> numerator, denominator; SQL over its columns), 0 where the denominator is 0."""
    return counts.withColumns({k: F.when(F.expr(f"({b}) > 0"), F.expr(f"({a})").cast("double") / F.expr(f"({b})").cast("double")).otherwise(F.lit(0.0)) for k, (a, b) in rates.items()})


def weighted_histogram(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, value, w: summed weights of each value."""
    return values.groupBy(*by, value).agg(F.sum(weight).alias("w"))


def at_most_failed(rows: DataFrame, group: list[str], order: list[str], q: str, most: int) -> DataFrame:
    """group, p: the probability that at most ``most`` of a group's rows fail, each with its own probability ``q``.

    The distribution of the number of failures grows by one row at a time and is cut at ``most``, so that a group
    carries its probabilities and most + 1 numbers.
    """
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * most)

    def add(dist: Column, x: Column) -> Column:
        return F.transform(dist, lambda p, i: p * (1 - x) + F.when(i > 0, F.get(dist, i - 1)).otherwise(F.lit(0.0)) * x)

    qs = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(q).cast("double").alias("_q")))), lambda r: r["_q"])
    return rows.groupBy(*group).agg(qs.alias("_qs")).select(*group, F.aggregate("_qs", start, add, lambda d: F.aggregate(d, F.lit(0.0), lambda a, x: a + x)).alias("p"))


def load_gate(runs: DataFrame, by: list[str], load: str, most: float) -> DataFrame:
    """by, ok, n_over: whether timings may be compared, that is every run's load is known and at most ``most``."""
    fine = F.coalesce((F.col(load) <= most) & ~F.isnan(F.col(load).cast("double")), F.lit(False))
    return runs.groupBy(*by).agg(F.bool_and(fine).alias("ok"), F.count_if(~fine).alias("n_over"))


def validated(fitted: DataFrame, refit: DataFrame, path: list[str]) -> DataFrame:
    """path, value, refit, inside: fitted parameters (value, low, high) beside a second fit's; inside if that lies in the interval."""
    both = fitted.join(refit.select(*path, F.col("value").alias("refit")), path)
    return both.select(*path, "value", "refit", F.col("refit").between(F.col("low"), F.col("high")).alias("inside"))


#: Stages at which a decode can end (fixed values).
STAGES = ["read_parsing", "orientation", "clustering", "consensus", "alignment", "indel_placement", "address", "inner_ecc", "crc", "coverage", "outer_ecc", "superblock", "archive"]


def terminal_stage(status: Column, code: Column, stage: Column, groups_failed: Column) -> Column:
    """Where a decode ended, from its own report: null for success; ``code`` and ``stage`` are those of a typed error, else null."""
    from_error = (
        F.when((code == "NO_SUPERBLOCK") | (stage == "superblock"), "superblock").when((code == "CONTAINER_HASH_MISMATCH") | (stage == "integrity"), "archive")
        .when(stage.isin("input", "format"), "read_parsing").otherwise(F.concat(F.lit("other:"), F.coalesce(stage, F.lit("None"))))
    )
    failed = F.when(F.coalesce(groups_failed, F.lit(0)) > 0, "outer_ecc").otherwise("archive")
    return F.when(code.isNotNull() | stage.isNotNull(), from_error).when(F.coalesce(status, F.lit("")) == "SUCCESS", F.lit(None).cast("string")).otherwise(failed)


def first_failing_stage(reads: DataFrame, band: int, parity: int) -> DataFrame:
    """Adds fate: the first stage at which a read failed, in the order of the pipeline; ``accepted`` otherwise.

    Columns: accepted, aligned, drift, erased_bytes, rs_ok, crc_ok.
    """
    aligned = F.col("aligned")
    fate = (
        F.when(F.col("accepted"), "accepted").when(~aligned & (F.col("drift") > band), "drift_beyond_band").when(~aligned, "path_beyond_band")
        .when(F.col("erased_bytes") > parity, "erasures_exceed_parity").when(~F.col("rs_ok"), "inner_ecc").when(~F.col("crc_ok"), "crc").otherwise("address")
    )
    return reads.withColumn("fate", fate)


def summaries(trials: DataFrame, parameter: str, value: str, success: str, measure: str) -> DataFrame:
    """parameter, value, n, n_success, mean of each point, each parameter (null value) and all trials (both null)."""
    return trials.rollup(parameter, value).agg(F.count("*").alias("n"), F.count_if(success).alias("n_success"), F.avg(measure).alias("mean"))


def rolled_up(samples: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """name, labels, total, most of metric samples: one row a label set, and one a name (labels null)."""
    return samples.rollup(name, *labels).agg(F.sum(value).alias("total"), F.max(value).alias("most")).where(F.col(name).isNotNull() & (F.col(labels[0]).isNull() == F.col(labels[-1]).isNull()))


def provenance(decisions: DataFrame, run: str, order: list[str], stage: str, action: str) -> DataFrame:
    """run, stage, n, first, last: decisions of each stage, with the first and last action in order."""
    key = lambda f: f(F.struct(*order, action))[action]
    return decisions.groupBy(run, stage).agg(F.count("*").alias("n"), key(F.min).alias("first"), key(F.max).alias("last"))
