"""Global alignment of reads to a reference, as runs of operations (M19-M21 rows).

Unit costs; ties go to the diagonal, then to a missing reference base, then to an
extra read base. Runs are (op, n): "=" equal, "X" different, "D" only in the
reference, "I" only in the read.
"""

from __future__ import annotations

import re

import numpy as np

Runs = list[tuple[str, int]]
EQUAL, OTHER, GONE, EXTRA = "=", "X", "D", "I"


def align(ref: str, read: str, band: int | None = None) -> tuple[int, Runs] | None:
    """(edit distance, runs); None if no path stays within ``band`` of the diagonal.

    Rows of the table run over the reference; only the columns of the band are kept.
    """
    n, m = len(ref), len(read)
    half = max(n, m) if band is None else band
    if abs(n - m) > half:
        return None
    a, b = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (ref, read))
    width, far = 2 * half + 1, n + m + 1
    shift = np.arange(width) - half  # column of cell d in row i: i + shift[d]
    cost = np.where((shift >= 0) & (shift <= m), shift, far)
    came = np.zeros((n + 1, width), np.int8)
    came[0] = 2
    padded = np.concatenate([np.zeros(half + 1, np.uint32), b, np.zeros(half + width + max(0, n - m) + 1, np.uint32)])
    for i in range(1, n + 1):
        column = i + shift
        straight = cost + (padded[i : i + width] != a[i - 1])
        straight[column < 1] = far
        gone = np.append(cost[1:], far) + 1
        best = np.minimum(straight, gone)
        kind = np.where(straight <= gone, 0, 1)
        best[(column < 0) | (column > m)] = far
        extra = np.minimum.accumulate(best - shift) + shift  # a chain of extra bases from the cheapest cell to the left
        kind[extra < best] = 2
        cost = np.where((column < 0) | (column > m), far, np.minimum(extra, best))
        came[i] = kind
    distance = int(cost[m - n + half])
    if distance >= far:
        return None
    i, j, ops = n, m, []
    while i or j:
        k = 2 if not i else 1 if not j else int(came[i, j - i + half])
        if k == 0:
            i, j = i - 1, j - 1
            ops.append(EQUAL if a[i] == b[j] else OTHER)
        elif k == 1:
            i -= 1
            ops.append(GONE)
        else:
            j -= 1
            ops.append(EXTRA)
    return distance, packed(reversed(ops))


#: Bytes of the steps that a batch of alignments keeps, and its pairs at most.
STEPS, PAIRS = 1 << 25, 1 << 9


def align_many(refs: list[str], reads: list[str], band: int) -> list[tuple[int, Runs] | None]:
    """``align`` of each pair, with pairs of like length together."""
    out: list[tuple[int, Runs] | None] = [None] * len(refs)
    order = sorted((i for i in range(len(refs)) if abs(len(refs[i]) - len(reads[i])) <= band), key=lambda i: -len(refs[i]))
    at = 0
    while at < len(order):
        part = order[at : at + max(1, min(PAIRS, STEPS // ((len(refs[order[at]]) + 1) * (2 * band + 1))))]
        for i, found in zip(part, _batch([refs[i] for i in part], [reads[i] for i in part], band), strict=True):
            out[i] = found
        at += len(part)
    return out


def _filled(texts: list[str], before: int, width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[before : before + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _batch(refs: list[str], reads: list[str], half: int) -> list[tuple[int, Runs] | None]:
    """``refs`` come longest first, so that those that still have rows are the first ones."""
    pairs = np.arange(len(refs))
    n, m = (np.array([len(s) for s in t], np.int32) for t in (refs, reads))
    width, rows = 2 * half + 1, int(n[0])
    shift = np.arange(width, dtype=np.int32) - half
    a, b = _filled(refs, 0, rows + 1), _filled(reads, half + 1, rows + width + half + 1)
    far = (n + m + 1)[:, None]
    cost = np.where((shift >= 0) & (shift <= m[:, None]), shift, far)
    came = np.zeros((rows + 1, len(refs), width), np.int8)
    for i in range(1, rows + 1):
        live = int(np.searchsorted(-n, -i, side="right"))
        column, own, most = i + shift, cost[:live], far[:live]
        outside = (column < 0) | (column > m[:live, None])
        straight = np.where(column < 1, most, own + (b[:live, i : i + width] != a[:live, i - 1, None]))
        gone = np.concatenate([own[:, 1:], most], axis=1) + 1
        kind = (straight > gone).astype(np.int8)
        best = np.where(outside, most, np.minimum(straight, gone))
        extra = np.minimum.accumulate(best - shift, axis=1) + shift
        kind[extra < best] = 2
        cost[:live] = np.where(outside, most, np.minimum(extra, best))
        came[i, :live] = kind
    distance = cost[pairs, m - n + half]
    i, j = np.where(distance < far[:, 0], n, 0), np.where(distance < far[:, 0], m, 0)
    steps = []
    while (i + j).any():
        done = (i == 0) & (j == 0)
        k = np.where(i == 0, 2, np.where(j == 0, 1, came[i, pairs, np.clip(j - i + half, 0, width - 1)]))
        same = (k == 0) & (a[pairs, i - 1] == b[pairs, j + half])
        steps.append(np.where(done, 0, np.where(same, ord(EQUAL), _OPS[k])).astype(np.uint8))
        i, j = i - ((k != 2) & ~done), j - ((k != 1) & ~done)
    ops = np.ascontiguousarray(np.stack(steps[::-1], axis=1)) if steps else np.zeros((len(refs), 0), np.uint8)
    return [(int(d), packed(o.tobytes().lstrip(b"\0").decode())) if d < f else None for d, f, o in zip(distance, far[:, 0], ops, strict=True)]


_OPS = np.frombuffer((OTHER + GONE + EXTRA).encode(), np.uint8)
_RUN, _GAP = re.compile(r"(.)\1*"), re.compile(f"{GONE}+|{EXTRA}+".encode())


def packed(ops) -> Runs:
    return [(run[1], run.end() - run.start()) for run in _RUN.finditer("".join(ops))]


def cigar(runs: Runs) -> str:
    return "".join(f"{n}{op}" for op, n in runs)


def spread(runs: Runs) -> str:
    return "".join(op * n for op, n in runs)


def leftmost(ref: str, read: str, runs: Runs) -> Runs:
    """The same alignment with every run of gone or extra bases as far left as it can go.

    A run moves over an equal base before it if the base that enters at its front equals the one that leaves at its
    end. The walk goes over single operations and repeats until nothing moves; runs that meet become one.
    """
    ops = bytearray(spread(runs).encode())
    moved = True
    while moved:
        moved, r, q, i = False, 0, 0, 0
        while gap := _GAP.search(ops, i):
            start, end = gap.span()
            gone, size = ops[start] == ord(GONE), end - start
            r, q = r + start - i, q + start - i
            text, at = (ref, r) if gone else (read, q)
            steps = 0
            while start - steps > 0 and ops[start - steps - 1] == ord(EQUAL) and text[at - steps - 1] == text[at - steps - 1 + size]:
                steps += 1
            if steps:
                ops[start - steps : end] = ops[start : start + 1] * size + EQUAL.encode() * steps
                moved = True
            r, q, i = (r + size, q, end) if gone else (r, q + size, end)
    return packed(ops.decode())


def rightmost(ref: str, read: str, runs: Runs) -> Runs:
    """The mirror image: every such run as far right as it can go."""
    return leftmost(ref[::-1], read[::-1], runs[::-1])[::-1]


def events(ref: str, read: str, runs: Runs) -> list[tuple[str, int, str, str]]:
    """(kind, site in the reference, reference letters, read letters): one a substitution, one a run of gone or extra bases."""
    out, i, j = [], 0, 0
    for op, n in runs:
        if op == OTHER:
            out += [("substitution", i + k, ref[i + k], read[j + k]) for k in range(n)]
        elif op == GONE:
            out.append(("deletion", i, ref[i : i + n], ""))
        elif op == EXTRA:
            out.append(("insertion", i, "", read[j : j + n]))
        i, j = i + n * (op != EXTRA), j + n * (op != GONE)
    return out
