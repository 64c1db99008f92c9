"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

In round j the suffixes of length j of all strings that long are inserted into
the sorted list of shorter ones, one symbol a string. The place of cX follows
from the row of X: all shorter first symbols, then the rank of that row among
rows with c before them. The list lives in three files (symbol before, common
prefix with the row above, suffix), each read once and written once a round.
The files are a task's own scratch, as Spark's spills are: no other process reads
them, a lost task starts anew, and they go at the end. An empty collection, and
empty strings, have empty suffixes only.
"""

from __future__ import annotations

import tempfile
from contextlib import ExitStack

import numpy as np

#: Common prefixes are kept up to this length.
MOST = 65_000


def sorted_suffixes(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, common prefix with the row above) of each suffix in order, empty ones first.

    Strings are arrays of symbols from 1 to 65,535. Equal suffixes go by the string's
    number. Prefixes end at the strings' ends.
    """
    m = len(strings)
    longest = max(map(len, strings), default=0)
    prefix = np.uint8 if longest < 255 else np.uint16
    place_type = np.int32 if sum(map(len, strings)) < 2**31 else np.int64
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.concatenate([*strings, np.zeros(0, np.uint16)]).astype(np.uint16)
    ends = np.cumsum(sizes)
    owner = np.arange(m, dtype=np.int32)
    before = np.zeros(m, np.uint16)
    before[sizes > 0] = text[ends[sizes > 0] - 1]
    rows = np.arange(m, dtype=np.int64)  # where the newest suffix of each string stands
    left = np.arange(m)[sizes > 0]  # strings that still grow
    with ExitStack() as open_files:
        # lists only grow, so that each round writes over the one before the last
        files = [[open_files.enter_context(tempfile.TemporaryFile()) for _ in range(3)] for _ in range(2)]
        for a, f in zip((before, np.zeros(m, prefix), ends.astype(place_type)), files[0], strict=True):
            _write(f, a)
        for j in range(1, int(sizes.max(initial=0)) + 1):
            b, lcp, suffix = (_read(f, t) for f, t in zip(files[0], (np.uint16, prefix, place_type), strict=True))
            old, n = len(b), len(left)
            order = np.argsort(b, kind="stable")
            first = int(np.searchsorted(b[order], 1)) if old else 0
            order = order[first:]  # rows with a symbol before them, by symbol then row
            place = np.empty(old, np.int64)
            place[order] = np.arange(len(order))
            at = place[rows[left]]  # position of each new suffix behind the m empty ones
            sort = np.argsort(at)
            at, left = at[sort], left[sort]
            # common prefixes of each new row with the row above, and of the row below with it
            symbol = b[order]
            above = np.zeros(n, np.uint16)
            has = at > 0
            has[has] = symbol[at[has] - 1] == symbol[at[has]]
            above[has] = _least(lcp, order[at[has] - 1] + 1, order[at[has]] + 1)
            below = at + 1 < len(order)
            below[below] = symbol[at[below] + 1] == symbol[at[below]]
            next_value = np.zeros(n, np.uint16)
            next_value[below] = _least(lcp, order[at[below]] + 1, order[at[below] + 1] + 1)
            # merge
            new_rows = m + at
            total = old + n
            is_new = np.zeros(total, bool)
            is_new[new_rows] = True
            start = ends[left] - j
            grows = sizes[left] > j
            symbols = np.zeros(n, np.uint16)
            symbols[grows] = text[start[grows] - 1]
            out = [_merged(a, v, is_new) for a, v in ((b, symbols), (lcp, above), (suffix, start))]
            touched = new_rows + 1
            known = touched < total
            known[known] = ~is_new[touched[known]]
            out[1][touched[known]] = np.where(below[known], next_value[known], 0)
            for a, f in zip(out, files[1], strict=True):
                _write(f, a)
            files.reverse()
            rows[left] = new_rows
            left = left[grows]
        lcp, suffix = _read(files[0][1], prefix), _read(files[0][2], place_type).astype(np.int64)
    # an empty suffix has the start of the next string: rows below m are the empty ones, in order
    string = np.searchsorted(ends, suffix, side="right").astype(np.int32)
    string[:m] = owner
    return string, suffix - (ends - sizes)[string], lcp


def _write(f, values: np.ndarray) -> None:
    f.seek(0)
    f.write(values.data)
    f.flush()


def _read(f, kind) -> np.ndarray:
    f.seek(0)
    return np.frombuffer(f.read(), kind)


def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 + the least of lcp[a:b] for each pair (a < b), at most MOST."""
    if not len(a):
        return np.zeros(0, np.uint16)
    cuts = np.empty(2 * len(a), np.int64)
    cuts[0::2], cuts[1::2] = a, b
    padded = np.append(lcp, lcp.dtype.type(0)).astype(np.uint16)
    return (np.minimum(np.minimum.reduceat(padded, cuts)[0::2], MOST) + 1).astype(np.uint16)


def _merged(old: np.ndarray, new: np.ndarray, is_new: np.ndarray) -> np.ndarray:
    out = np.empty(len(is_new), old.dtype)
    out[is_new], out[~is_new] = new, old
    return out


def repeated_windows(strings: list[np.ndarray], width: int) -> list[list[tuple[int, int]]]:
    """Per string the intervals (first, last) of starts whose ``width`` symbols start at another suffix too."""
    string, start, lcp = sorted_suffixes(strings)
    far = np.append(lcp >= width, False)
    hit = far[:-1] | far[1:]
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    found = np.flatnonzero(hit)
    key = np.lexsort((start[found], string[found]))
    for s, p in zip(string[found][key].tolist(), start[found][key].tolist(), strict=True):
        if out[s] and out[s][-1][1] == p - 1:
            out[s][-1] = (out[s][-1][0], p)
        else:
            out[s].append((p, p))
    return out
