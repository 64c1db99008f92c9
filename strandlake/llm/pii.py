"""Personal data: base patterns, then a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns with checks and always
stay. The field labels every token that holds a digit or "@" (all other tokens
are clamped to "none", and only an email has letters): potentials from a token's shape and its neighbours, chain
edges between neighbouring tokens, and skip edges between distant tokens that
repeat or resemble each other (same text without punctuation, same digits, same
last seven digits, same mailbox), linked in order of occurrence. Loopy message
passing carries labels along the edges, with base spans as evidence, so a value
recognised once is recognised where its surroundings don't show it. A token
outside base spans becomes a span when a label reaches the field's threshold.

Weights are learned by pseudo-likelihood from the base spans of a bounded sample
of documents (``SAMPLE`` ids, ``TOKENS`` rows in all, at most ``TOKENS_A_DOCUMENT``
of a document, each the first by a hash over whole texts). What the patterns miss
is unlabelled, not negative: a token with "@", or without letters and with ``LIKE``
digits or more, outside base spans gives no row. For a hashed half of the labelled tokens a further row
hides the match: the value stands alone, without its neighbours and its prefix, and
only a skip edge to the mention with its label tells. The threshold is the least
one with a precision of ``PRECISION`` on rows that were held out from learning.

Defined results: a null text is empty and has no spans; offsets are code points,
end exclusive; repeated rows get equal spans; an empty table gives an empty
result; texts of any length are read whole; extra columns, whatever their names,
are ignored by ``digests`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import prepare

KINDS = ("email", "ip", "card", "phone")
SAMPLE, TOKENS, TOKENS_A_DOCUMENT = 20_000, 30_000, 50
LIKE, PRECISION, SURE, ROUNDS = 7, 0.995, 0.9, 12

_SOME = re.compile(r"[0-9@]")
_MAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_EDGE = ".,;:!?()[]{}\"'<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _mails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@" so that time stays linear."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        right = _MAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            out.append((start, right.end()))
            end = right.end()
        else:
            end = max(end, at + 1)  # nothing before this sign can belong to a later match
        at = text.find("@", max(at + 1, end))
    return out


def base(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping within the kind."""
    if not _SOME.search(text):
        return [[], [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
    card = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15] if "+" in text else []
    return [_mails(text), ip, card, phone]


def tokens(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or "@", found from these signs outwards so that time stays linear in any text."""
    out, end = [], 0
    while m := _SOME.search(text, end):
        start = max(end, *(text.rfind(c, end, m.start()) + 1 for c in _SPACES))
        after = _SPACE.search(text, m.end())
        end = after.start() if after else len(text)
        out.append((start, end))
    return out


def _bucket(n: int, edges: tuple[int, ...]) -> list[float]:
    k = sum(n >= e for e in edges)
    return [float(k == i) for i in range(len(edges) + 1)]


def shapes(text: str, spans: list[tuple[int, int]], near: np.ndarray) -> np.ndarray:
    """Features of each token; near: whether a token follows the one before with only white space between."""
    rows = []
    digits = [sum(c in "0123456789" for c in text[a:b]) for a, b in spans]
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        s = t.strip(_EDGE)
        before = bool(i and near[i])
        after = bool(i + 1 < len(spans) and near[i + 1])
        run = digits[i] + (digits[i - 1] if before else 0) + (digits[i + 1] if after else 0)
        domain = s.rpartition("@")[2]
        rows.append([
            1.0, float("@" in s), float("@" in s and "." in domain.strip(".")), float(s.isdigit()), float(t.startswith("+")), float("(" in t or ")" in t),
            float("-" in s), float(any(c.isalpha() for c in s)), float(any(c.isupper() for c in s)), float(any(c in "/:$€£%=_&#*" for c in s)),
            float("@" not in s and any(c.isalpha() for c in s)), float(s.isdigit() and 16 <= len(s) <= 19), float(before), float(after), float(before and text[spans[i - 1][0]] == "+"),
            *_bucket(digits[i], (1, 4, 7, 12, 16, 20)), *_bucket(s.count("."), (1, 2, 3, 4)), *_bucket(run, (8, 12, 16, 20)),
        ])
    return np.array(rows, np.float64).reshape(len(rows), -1)


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chain edges, skip edges, near)."""
    near = np.zeros(len(spans), bool)
    for i in range(1, len(spans)):
        between = text[spans[i - 1][1] : spans[i][0]]
        near[i] = len(between) <= 3 and not between.strip()
    chain = np.flatnonzero(near)
    last: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for i, (a, b) in enumerate(spans):
        s = text[a:b].strip(_EDGE).lower()
        digits = "".join(c for c in s if c in "0123456789")
        keys = ["=" + s] if len(s) >= 5 else []
        if len(digits) >= 7:
            keys += ["d" + digits, "t" + digits[-7:]]
        if "@" in s:
            keys.append("m" + s.partition("@")[0])
        for k in keys:
            if k in last and last[k] != i:
                skip.add((last[k], i))
            last[k] = i
    return np.stack([chain - 1, chain], 1).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2), near


def labels(spans: list[tuple[int, int]], found: list[list[tuple[int, int]]]) -> np.ndarray:
    """Kind (1 to 4) of the base span that a token touches, else 0."""
    out = np.zeros(len(spans), np.int64)
    ends = np.array([b for _, b in spans], np.int64)
    for k in reversed(range(len(KINDS))):
        for a, b in found[k]:
            i = int(np.searchsorted(ends, a, side="right"))
            while i < len(spans) and spans[i][0] < b:
                out[i] = k + 1
                i += 1
    return out


N = len(KINDS) + 1
#: Columns of ``shapes``: holds "@"; holds letters and no "@".
_AT, _LETTERS = 1, 10


def barred(x: np.ndarray) -> np.ndarray:
    """What is added to the scores of tokens with these features: only an email has letters or "@"."""
    out = np.zeros((len(x), N))
    out[(x[:, _AT] > 0) | (x[:, _LETTERS] > 0), KINDS.index("email") + 2 :] = -50.0
    return out


def _same(weights: np.ndarray) -> np.ndarray:
    """Edge potentials: (both none, both the same kind)."""
    return np.diag([weights[0]] + [weights[1]] * len(KINDS))


class Field:
    """unary: (features, labels); chain and skip: weights of equal labels (none, a kind)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, sure: float = SURE):
        self.unary, self.chain, self.skip, self.sure = unary, chain, skip, sure

    def marginals(self, x: np.ndarray, clamp: np.ndarray, chain: np.ndarray, skip: np.ndarray, offset: np.ndarray | float = 0.0) -> np.ndarray:
        """Label probabilities of each token by damped loopy belief propagation."""
        score = x @ self.unary + offset
        score[clamp > 0] = -50.0
        score[clamp > 0, clamp[clamp > 0]] = 50.0
        pair = np.concatenate([chain, skip])
        if len(pair):
            edge = np.concatenate([np.repeat(_same(w)[None], len(e), 0) for w, e in ((self.chain, chain), (self.skip, skip))])
            source, target = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
            edge, back = np.concatenate([edge, edge]), np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
            message = np.zeros((len(source), N))
            for _ in range(ROUNDS):
                total = score.copy()
                np.add.at(total, target, message)
                inward = total[source] - message[back]
                new = _logsum(inward[:, :, None] + edge, 1)
                new -= _logsum(new, 1)[:, None]
                change = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                if change < 1e-3:
                    break
            np.add.at(score, target, message)
        return np.exp(score - _logsum(score, 1)[:, None])


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def _alone(token: str) -> str:
    """What a shortened mention of the token's value shows: the mailbox, or the text without signs around it."""
    s = token.strip(_EDGE + "+")
    return s.partition("@")[0] if "@" in s else s


def examples(text: str, most: int) -> list[list[float]]:
    """Rows for learning: label, equal-label counts over chain and skip edges (2 x N), features."""
    spans = tokens(text)
    if not spans:
        return []
    chain, skip, near = edges(text, spans)
    y = labels(spans, base(text))
    order = sorted((zlib.crc32(b"%d %s" % (i, text[a:b].encode("utf-8", "replace"))), i) for i, (a, b) in enumerate(spans))
    x = shapes(text, spans, near)
    counts = np.zeros((len(spans), 2 * N))
    for at, e in ((0, chain), (N, skip)):
        np.add.at(counts, (e[:, 0], at + y[e[:, 1]]), 1)
        np.add.at(counts, (e[:, 1], at + y[e[:, 0]]), 1)
    out: list[list[float]] = []
    for h, i in order:
        if len(out) >= most:
            break
        t = text[slice(*spans[i])]
        if y[i] or not ("@" in t or sum(c in "0123456789" for c in t) >= LIKE and not any(map(str.isalpha, t))):
            out.append([float(y[i]), *counts[i], *x[i]])
            bare = _alone(t)
            if h & 1 and _SOME.search(bare):
                out.append([float(y[i]), *np.zeros(N), *np.eye(N)[y[i]], *shapes(bare, [(0, len(bare))], np.zeros(1, bool))[0]])
    return out[:most]


def fit(rows: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Field:
    """Pseudo-likelihood by gradient steps with momentum and per-weight scales; every fourth row sets the threshold."""
    held = np.arange(len(rows)) % 4 == 3
    rows, aside = rows[~held], rows[held]
    y, chain, skip, x = rows[:, 0].astype(int), rows[:, 1 : 1 + N], rows[:, 1 + N : 1 + 2 * N], rows[:, 1 + 2 * N :]
    w = [np.zeros((x.shape[1], N)), np.zeros(2), np.zeros(2)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    target, offset = np.eye(N)[y], barred(x)
    tied = np.array([0] + [1] * len(KINDS))
    for t in range(1, steps + 1):
        score = x @ w[0] + chain * w[1][tied] + skip * w[2][tied] + offset
        delta = (np.exp(score - _logsum(score, 1)[:, None]) - target) / len(y)
        flat = [np.bincount(tied, (delta * c).sum(0), 2) for c in (chain, skip)]
        for i, g in enumerate([x.T @ delta, *flat]):
            g = g + ridge * w[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Field(w[0], w[1], w[2], _threshold(w, aside, tied))


def _threshold(w: list[np.ndarray], rows: np.ndarray, tied: np.ndarray) -> float:
    """The least probability of a kind from which on ``PRECISION`` of the rows are of that kind; SURE without rows."""
    if not len(rows):
        return SURE
    x = rows[:, 1 + 2 * N :]
    score = x @ w[0] + barred(x) + rows[:, 1 : 1 + N] * w[1][tied] + rows[:, 1 + N : 1 + 2 * N] * w[2][tied]
    p = np.exp(score - _logsum(score, 1)[:, None])[:, 1:]
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum(p.argmax(1)[order] + 1 == rows[order, 0])
    good = np.flatnonzero(right >= PRECISION * np.arange(1, len(rows) + 1))
    return max(0.5, float(p.max(1)[order][good[-1]])) if len(good) else SURE


def learn(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Field | None:
    """The field learned from a bounded sample of ``docs``; None if it has no tokens to learn from."""
    prepare(docs.sparkSession)
    ids = docs.select(id_column).where(F.col(id_column).isNotNull()).distinct().orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE)
    sample = docs.select(id_column, text).join(F.broadcast(ids), id_column, "left_semi")

    def run(batches):
        for b in batches:
            out = [(k, i, r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, r in enumerate(examples(t or "", TOKENS_A_DOCUMENT))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["k", "i", "r"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = sample.mapInArrow(run, f"k {kind}, i int, r array<double>").orderBy(F.xxhash64("k"), "k", "i", "r").limit(TOKENS).collect()
    return fit(np.array([r["r"] for r in rows])) if rows else None


def find(text: str, field: Field | None) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base spans, added spans) of each kind."""
    found = base(text)
    added: list[list[tuple[int, int]]] = [[], [], [], []]
    spans = tokens(text) if field is not None else []
    if spans:
        y = labels(spans, found)
        if not y.all():
            chain, skip, near = edges(text, spans)
            x = shapes(text, spans, near)
            p = field.marginals(x, y, chain, skip, barred(x))
            for i in np.flatnonzero((y == 0) & (p[:, 1:].max(1) >= field.sure)):
                a, b = spans[i]
                t = text[a:b]
                a, b = a + len(t) - len(t.lstrip(_EDGE)), b - (len(t) - len(t.rstrip(_EDGE)))
                if a < b:
                    added[int(p[i, 1:].argmax())].append((a, b))
    return found, added


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in zip(KINDS, spans, strict=True) for a, b in sorted(found))


def digests(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_spans (all)."""
    field = field or learn(docs, id_column, text)
    names = [id_column, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in b.column(1).to_pylist():
                found, added = find(t or "", field)
                row = [*map(len, found), hashlib.sha256(joined(found).encode()).hexdigest(), joined([f + a for f, a in zip(found, added, strict=True)]), sum(map(len, added)), sum(map(len, found + added))]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, field: Field | None) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    found, added = find(text, field)
    spans = sorted((a, b, k) for k, f, x in zip(KINDS, found, added, strict=True) for a, b in f + x)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with masked texts; null texts stay null, other columns stay as they are."""
    field = field or learn(docs, id_column, text)

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t, field) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, mask(F.col(text)))
