"""Edit distances of many pairs at once, in bits of 64 rows of the table (M21 rows)."""

from __future__ import annotations

import numpy as np

#: Bytes of a batch's letter masks, its pairs at most, and the columns between two looks at which pairs are lost.
MASKS, PAIRS, LOOK = 1 << 24, 1 << 10, 64
_ONE, _TOP = np.uint64(1), np.uint64(63)


def within(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """The edit distance of each pair, -1 where it is over the pair's ``most``."""
    most = np.asarray(most, np.int64)
    out = np.full(len(left), -1, np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    low, high = sizes.min(1, initial=1 << 40), sizes.max(1, initial=0)
    empty = low == 0
    out[empty] = np.where(high[empty] <= most[empty], high[empty], -1)
    order = np.flatnonzero(~empty & (high - low <= most))
    order = order[np.lexsort((high[order], low[order]))]
    at = 0
    while at < len(order):
        part = order[at : at + PAIRS]
        texts = [(left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i]) for i in part.tolist()]
        points = np.frombuffer("".join(a + b for a, b in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.zeros(int(points.max()) + 1, bool)
        known[points] = True
        letters, codes = int(known.sum()), (np.cumsum(known) - 1)[points]
        n, m = low[part], high[part]
        fits = next((f for f in (len(part), *(len(part) >> s for s in range(1, 11))) if f and f * 8 * letters * -(-int(n[f - 1]) // 64) <= MASKS), 1)
        ends = np.cumsum(n + m)
        out[part[:fits]] = _batch(codes[: ends[fits - 1]], ends[:fits] - n[:fits] - m[:fits], n[:fits], m[:fits], most[part[:fits]], letters)
        at += fits
    return out


def _batch(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, m: np.ndarray, most: np.ndarray, letters: int) -> np.ndarray:
    """``codes`` holds, from ``starts`` on, each pair's pattern (n letters: the rows) and text (m letters: the columns)."""
    order = np.argsort(-m, kind="stable")  # pairs that still have columns come first
    starts, n, m, most = starts[order], n[order], m[order], most[order]
    pairs, words = len(n), -(-int(n.max()) // 64)
    masks = np.zeros((letters * pairs, words), np.uint64)  # a letter's words of a pair side by side
    lane = np.repeat(np.arange(pairs), n)
    row = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
    np.add.at(masks.reshape(-1), (codes[starts[lane] + row] * pairs + lane) * words + (row >> 6), _ONE << (row & 63).astype(np.uint64))
    columns = np.minimum(np.arange(int(m.max()))[:, None], (m - 1)[None, :])
    text = codes[(starts + n)[None, :] + columns] * pairs + np.arange(pairs)
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    out, own = np.full(pairs, -1, np.int64), np.arange(pairs)  # own: the lane in masks and text of each pair that is left

    def totals(count: int) -> np.ndarray:
        """The table's column as differences, rows 1 to the longest pattern, summed from the top."""
        as_bits = lambda x: np.unpackbits(np.ascontiguousarray(x[:, :count].T).view(np.uint8), axis=1, bitorder="little").view(np.int8)
        return np.cumsum(as_bits(up) - as_bits(down), axis=1, dtype=np.int32)

    def finish(first: int, last: int) -> None:
        found = m[own[first:last]] + totals(last)[np.arange(first, last), n[own[first:last]] - 1]
        out[own[first:last]] = np.where(found <= most[own[first:last]], found, -1)

    live = pairs
    for j in range(int(m.max())):
        still = int(np.searchsorted(-m[own[:live]], -j, side="left"))  # those with more than j columns
        if still < live:
            finish(still, live)
            live = still
        if j and not j % LOOK and live:
            rows = np.arange(1, 64 * words + 1)
            lanes = own[:live]
            least = j + totals(live) + np.abs((n[lanes, None] - rows) - (m[lanes, None] - j))
            least[rows[None, :] > n[lanes, None]] = 1 << 30
            top = j + np.abs(n[lanes] - (m[lanes] - j))
            keep = np.minimum(least.min(1), top) <= most[lanes]
            if not keep.all():
                own, up, down = lanes[keep], np.ascontiguousarray(up[:, :live][:, keep]), np.ascontiguousarray(down[:, :live][:, keep])
                live = len(own)
        if not live:
            return _back(out, order)
        lanes = own[:live]
        plus, minus = np.ones(live, np.uint64), np.zeros(live, np.uint64)
        own_masks = np.ascontiguousarray(masks.take(text[j, lanes], axis=0).T)
        for w in range(words):
            pv, mv = up[w, :live], down[w, :live]
            eq = own_masks[w]
            xv = eq | mv
            eq |= minus
            mh = eq & pv
            mh += pv
            mh ^= pv
            mh |= eq
            ph = mh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh &= pv
            next_plus, next_minus = ph >> _TOP, mh >> _TOP
            ph <<= _ONE
            ph |= plus
            mh <<= _ONE
            mh |= minus
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
            plus, minus = next_plus, next_minus
    finish(0, live)
    return _back(out, order)


def _back(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(found)
    out[order] = found
    return out
