"""Quality rules: a decision list learned by sequential covering.

Native: the statistics and the emitted rules are Spark expressions; learning
runs on the driver over the statistics of a bounded sample of labelled rows.

The learner repeats: grow a conjunction of thresholds by information gain on
two thirds of the sample, prune its last conditions on the other third, keep it
if it is precise there, and remove the rows it covers. The rules become one
ordered ``when ... when ... otherwise`` expression.

Defined results: a null text has no words. Texts of any length are read whole.
Repeated rows are judged alike; a document labelled twice counts once, with its
lowest label. With no usable labels the list is empty and only the base rule
rejects. Empty tables give empty results; extra columns, whatever their names, are
ignored by ``judged`` and kept by ``keep``.

Equality of 3-word windows is decided by 64-bit hashes within a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, fold, let, text_of

#: Labelled rows to learn from, at most (the first by a hash of their id).
SAMPLE = 8_000
#: Rules and conditions in a rule, at most; precision that a rule needs on the pruning third.
MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 12, 3, 0.9, 3

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct"]


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these sorted starts."""
    steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1), p + 3) - p))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    def starts(h):
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(s, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, i: F.coalesce((i > 0) & (F.get(s, i - 1)["x"] == e["x"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))),
            lambda e: e["i"])))

    def of(h):
        n = F.size(F.array_distinct(h))
        return F.when(n == F.size(h), F.lit(0)).otherwise(let(starts(h), _covered))

    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, of)


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(text: Column) -> Column:
    """A struct of STATS of the whole text, all long."""
    def of(t):
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        def with_words(w):
            def with_lines(n):
                values = {
                    "n_words": F.size(w),
                    "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
                    "n_symbols": _removed(t, SYMBOLS),
                    "n_dup_lines": F.size(n) - F.size(F.array_distinct(n)),
                    "n_repeat_words": _repeat_words(w),
                    "n_lines": F.size(n),
                    "n_upper": _removed(t, UPPER),
                    "n_marks": _removed(t, "!?"),
                    "n_distinct": F.size(F.array_distinct(w)),
                }
                return F.struct(*[values[k].cast("long").alias(k) for k in STATS])
            return let(lines, with_lines)
        return let(F.filter(F.split(t, SPACE, -1), lambda x: x != ""), with_words)
    return let(text, of)


#: Features of the rules: numerator and denominator among STATS.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "words": ("n_words", None),
}


def _value(row, name: str) -> float:
    top, bottom = FEATURES[name]
    return float(row[top]) if bottom is None else row[top] / max(1, row[bottom])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict) -> bool:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, stats: str) -> Column:
        top, bottom = FEATURES[self.feature]
        value = F.col(f"{stats}.{top}").cast("double")
        if bottom:
            value = value / F.greatest(F.lit(1), F.col(f"{stats}.{bottom}")).cast("double")
        return value >= self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict) -> bool:
        return all(c.holds(x) for c in self.conditions)

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(stats)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _candidates(rows: list[dict]) -> list[Condition]:
    found = []
    for f in FEATURES:
        values = sorted({x[f] for x in rows})
        cuts = values if len(values) <= 40 else [values[round(i * (len(values) - 1) / 39)] for i in range(40)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found += [Condition(f, True, (a + b) / 2), Condition(f, False, (a + b) / 2)]
    return found


def _grow(bad: list[dict], good: list[dict]) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    candidates = _candidates(bad + good)
    while good and len(rule) < MAX_CONDITIONS:
        base = math.log2(len(bad) / (len(bad) + len(good)))
        best, most = None, 1e-9
        for c in candidates:
            p = sum(c.holds(x) for x in bad)
            if p < MIN_COVER:
                continue
            n = sum(c.holds(x) for x in good)
            gain = p * (math.log2(p / (p + n)) - base)
            if gain > most:
                best, most = c, gain
        if best is None:
            break
        rule += (best,)
        bad, good = [x for x in bad if best.holds(x)], [x for x in good if best.holds(x)]
    return rule


def _prune(rule: tuple[Condition, ...], bad: list[dict], good: list[dict]) -> tuple[Condition, ...]:
    def worth(k: int) -> float:
        r = Rule(rule[:k])
        p, n = sum(r.holds(x) for x in bad), sum(r.holds(x) for x in good)
        return (p - n) / (p + n) if p + n else -1.0
    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def learn(examples: list[tuple[dict, int]]) -> list[Rule]:
    """The ordered rules that reject; examples: features and the label (1: good)."""
    rules: list[Rule] = []
    grow, prune = [e for i, e in enumerate(examples) if i % 3], [e for i, e in enumerate(examples) if i % 3 == 0]
    while len(rules) < MAX_RULES:
        bad, good = [x for x, y in grow if y == 0], [x for x, y in grow if y == 1]
        if len(bad) < MIN_COVER or not good:
            break
        conditions = _grow(bad, good)
        if not conditions:
            break
        p_bad, p_good = [x for x, y in prune if y == 0], [x for x, y in prune if y == 1]
        rule = Rule(_prune(conditions, p_bad, p_good))
        hit, miss = sum(rule.holds(x) for x in p_bad + bad), sum(rule.holds(x) for x in p_good + good)
        on_pruning = sum(rule.holds(x) for x in p_good), sum(rule.holds(x) for x in p_bad)
        if hit < MIN_COVER or hit / (hit + miss) < MIN_PRECISION or on_pruning[0] > on_pruning[1]:
            break
        rules.append(rule)
        grow, prune = [e for e in grow if not rule.holds(e[0])], [e for e in prune if not rule.holds(e[0])]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[dict, int]]:
    """Features and labels of at most ``sample`` labelled documents outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", statistics(text_of()).alias("s"))
        .groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    )
    return [({f: _value(r["s"], f) for f in FEATURES}, r["quality"]) for r in rows]


def _judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (carried, text) with stats (struct), base_failed, rule (number of the rule that rejects, or null) and kept."""
    out = rows.select("carried", statistics(text_of()).alias("stats"))
    n, again = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    which = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        which = F.when(rule.column("stats"), F.lit(i)).otherwise(which)
    failed = (n < 50) | (100 * again > 50 * n)
    return out.withColumns({"base_failed": failed, "rule": which}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judged(docs: DataFrame, rules: list[Rule], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, stats (struct), base_failed, rule (number of the rule that rejects, or null) and kept of every row."""
    rows = docs.select(F.col(f"`{id_column}`").alias("carried"), F.col(f"`{text}`").alias("text"))
    return _judged(rows, rules).withColumnRenamed("carried", id_column)


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the decision list accept, all columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"), F.col(f"`{text}`").alias("text"))
    return _judged(rows, rules).where("kept").select("carried.*")
