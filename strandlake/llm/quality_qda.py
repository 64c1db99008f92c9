"""Quality scores by regularised quadratic discriminant analysis.

Each text gives a vector of statistics, transformed (logarithms and logits of
shares) to be nearly normal. Sums and outer products of the labelled rows are
added up per class over the whole table; class covariances are shrunk towards
their mean variance (oracle approximating shrinkage). A score is the logistic of
the difference of the two Mahalanobis log-densities, with the Cholesky factors
computed once and sent along.

Learning uses only rows whose crc32(id) mod 3 is not 1; labels, language, source
and id are never inputs.

Defined results: null and empty texts have the statistics of an empty text and a
score. Labels other than 0 or 1 are ignored; of several labels of one id the
least counts. With a class missing all scores are 0.5. Texts of any length are
measured whole. Repeated rows get equal scores (and count as often in learning).
Empty tables give empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, fold

_WORD_ENDS = ".!?:;"
NAMES = [
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "upper", "digits", "punctuation", "symbols",
    "marks", "dup_lines", "line_words", "repeat_pairs", "compressed", "short_words", "common_word", "stops",
]


def _logit(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5)) if whole >= part else 0.0


def features(text: str) -> list[float]:
    """The transformed statistics of a whole text."""
    words = text.split()
    n, chars = len(words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = sum(int(x) for x in lengths)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    marks = text.count("!") + text.count("?")
    other = sum(map(text.count, ".,;:'\"()-"))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    data = text.encode("utf-8", "replace")
    return [
        math.log1p(chars), math.log1p(n),
        math.log1p(letters / max(1, n)), math.log1p(float(lengths.std()) if n else 0.0),
        _logit(len(seen), n), _logit(upper, letters), _logit(digits, letters), _logit(other, letters), _logit(symbols, letters),
        _logit(marks, letters), _logit(len(lines) - len(set(lines)), len(lines)), math.log1p(n / max(1, len(lines))),
        _logit(max(0, n - 1 - pairs), max(0, n - 1)), math.log((len(zlib.compress(data, 1)) + 20) / (len(data) + 20)),
        _logit(int((lengths <= 3).sum()), n), _logit(max(seen.values(), default=0), n), _logit(sum(1 for w in words if w[-1] in _WORD_ENDS), n),
    ]


def vectors(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_column, "x"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): log prior minus half log determinant, mean, inverse Cholesky factor."""

    constant: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), 0.5)
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for c, m, f in zip(self.constant, self.mean, self.factor, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Oracle approximating shrinkage towards the mean variance."""
    p = len(cov)
    t, t2 = np.trace(cov), (cov**2).sum()
    bottom = (n + 1 - 2 / p) * (t2 - t * t / p)
    rho = 1.0 if bottom <= 0 else min(1.0, ((1 - 2 / p) * t2 + t * t) / bottom)
    return (1 - rho) * cov + rho * (t / p) * np.eye(p) + 1e-6 * np.eye(p)


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """moments: class -> (rows, sums, sums of products). Features are scaled by the pooled deviation first."""
    if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
        return Model([], [], [])
    total = sum(moments[k][0] for k in (0, 1))
    mean = sum(moments[k][1] for k in (0, 1)) / total
    spread = np.sqrt(np.maximum(np.diag(sum(moments[k][2] for k in (0, 1))) / total - mean**2, 1e-6))
    out = Model([], [], [])
    for k in (0, 1):
        n, s, ss = moments[k]
        m = s / n
        cov = shrunk((ss / n - np.outer(m, m)) / np.outer(spread, spread), n)
        lower = np.linalg.cholesky(cov)
        out.constant.append(math.log(n / total) - float(np.log(np.diag(lower)).sum()))
        out.mean.append(m)
        out.factor.append(np.linalg.inv(lower) / spread)
    return out


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products per class of ``rows`` (x, quality): partial sums per task, then one row a class."""
    p = len(NAMES)

    def partial(batches):
        sums = np.zeros((2, 1 + p + p * p))
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.array(b.column(0).flatten()).reshape(-1, p)
            for k in (0, 1):
                v = x[y == k]
                sums[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "v"])

    parts = rows.select("x", "quality").mapInArrow(partial, "k int, v array<double>")
    summed = parts.select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # bounded: 2 (1 + p + p^2)
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + p + p * p)
        for r in summed:
            if r["k"] == k:
                v[r["i"]] = r["v"]
        out[k] = (int(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p))
    return out


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of ``docs``, learned from ``labels`` (id, quality)."""
    x = cut(vectors(docs, id_column, text))  # id and x alone, so that no other column can clash
    known = labels.where(F.col("quality").isin(0, 1) & (fold(id_column) != 1)).groupBy(id_column).agg(F.min("quality").alias("quality"))
    model = fit(moments(x.join(known, id_column)))

    @F.arrow_udf("double")
    def scored(v: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array(v.flatten()).reshape(-1, len(NAMES))), pa.float64())

    return x.select(id_column, (fold(id_column) == 1).alias("held_out"), scored("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
