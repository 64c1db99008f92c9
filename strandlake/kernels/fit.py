"""Fits on small histograms that Spark has summed up: coverage families by likelihood and AIC, simplex search."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def simplex(f: Callable[[np.ndarray], float], start, step: float = 0.5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Nelder-Mead: (point, value)."""
    x0 = np.asarray(start, float)
    points = [x0] + [x0 + step * e for e in np.eye(len(x0))]
    pairs = sorted(((f(p), tuple(p)) for p in points), key=lambda v: v[0])
    for _ in range(rounds):
        *best, (worst, w) = pairs
        centre = np.mean([p for _, p in best], axis=0)
        w = np.array(w)
        reflected = centre + (centre - w)
        v = f(reflected)
        if v < best[0][0]:
            far = centre + 2 * (centre - w)
            fv = f(far)
            new = (fv, tuple(far)) if fv < v else (v, tuple(reflected))
        elif v < best[-1][0]:
            new = (v, tuple(reflected))
        else:
            near = centre + 0.5 * ((reflected if v < worst else w) - centre)
            nv = f(near)
            if nv >= min(v, worst):
                first = np.array(best[0][1])
                pairs = sorted([best[0]] + [(f(q), tuple(q)) for _, p in [*best[1:], (worst, w)] for q in [first + 0.5 * (np.array(p) - first)]], key=lambda t: t[0])
                continue
            new = (nv, tuple(near))
        pairs = sorted([*best, new], key=lambda t: t[0])
    return np.array(pairs[0][1]), pairs[0][0]


_LG = np.vectorize(math.lgamma)
_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(40)


def log_pmf(family: str, n: np.ndarray, mean: float, shape: float = 0.0) -> np.ndarray:
    """Log probabilities of counts: poisson, negative-binomial (shape: dispersion) or lognormal (shape: sigma of the rate's logarithm)."""
    n = np.asarray(n, float)
    if family == "poisson":
        return n * math.log(mean) - mean - _LG(n + 1)
    if family == "negative-binomial":
        return _LG(n + shape) - math.lgamma(shape) - _LG(n + 1) + shape * math.log(shape / (shape + mean)) + n * math.log(mean / (shape + mean))
    if family == "lognormal":
        rate = np.log(mean) + shape * math.sqrt(2) * _NODES - shape * shape / 2
        each = n[None] * rate[:, None] - np.exp(rate)[:, None] - _LG(n + 1)[None] + np.log(_WEIGHTS / math.sqrt(math.pi))[:, None]
        top = each.max(0)
        return top + np.log(np.exp(each - top).sum(0))
    raise ValueError(f"unknown family {family!r}")


def coverage(histogram: np.ndarray) -> dict:
    """The family with the least AIC for a histogram of reads per reference: family, zero_inflated, mean, shape, dropout, aic."""
    h = np.asarray(histogram, float)
    n = np.arange(len(h))
    mean = max(1e-3, float((h * n).sum() / h.sum()))
    spread = max(1e-3, float((h * (n - mean) ** 2).sum() / h.sum()) - mean)
    starts = {"poisson": [], "negative-binomial": [math.log(max(0.05, mean * mean / spread))], "lognormal": [math.log(max(0.02, math.sqrt(math.log1p(spread / mean**2))))]}
    best = None
    for family, start in starts.items():
        for zero in (False, True):
            def loss(x, family=family, zero=zero):
                p = np.exp(log_pmf(family, n, math.exp(min(x[0], 20)), min(math.exp(min(x[1], 20)), 1e6) if family != "poisson" else 0.0))
                if zero:
                    share = 1 / (1 + math.exp(-max(-50.0, min(50.0, x[-1]))))
                    p = (1 - share) * p
                    p[0] += share
                return -float((h * np.log(np.maximum(p, 1e-300))).sum())
            x, v = simplex(loss, [math.log(mean), *start, *([-3.0] if zero else [])])
            x, v = simplex(loss, x, 0.1)
            aic = 2 * len(x) + 2 * v
            if best is None or aic < best["aic"] - 1e-9:
                best = {"family": family, "zero_inflated": zero, "mean": math.exp(x[0]), "shape": math.exp(x[1]) if start else None, "dropout": 1 / (1 + math.exp(-x[-1])) if zero else 0.0, "aic": aic}
    return best


def proportional_fit(table: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Scale a small table until its margins are those given."""
    out = table.astype(float).copy()
    for _ in range(rounds):
        out *= np.divide(rows, out.sum(1), out=np.ones_like(rows, float), where=out.sum(1) > 0)[:, None]
        out *= np.divide(columns, out.sum(0), out=np.ones_like(columns, float), where=out.sum(0) > 0)
    return out
