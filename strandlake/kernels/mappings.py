"""Other byte-to-base mappings: a 256-word codebook of eight bases, and rotating base-3 digits (no equal neighbours)."""

from __future__ import annotations

from functools import lru_cache
from itertools import islice, product

import numpy as np

WORD, DIGITS = 8, 6


@lru_cache(maxsize=1)
def words() -> np.ndarray:
    """(256, 8): the first words A......T in alphabetical order with four G or C and no run above three."""
    def good(w: tuple[int, ...]) -> bool:
        runs = all(len({*w[i : i + 4]}) > 1 for i in range(WORD - 3))
        return sum(b in (1, 2) for b in w) == 4 and runs
    return np.array(list(islice(filter(good, ((0, *m, 3) for m in product(range(4), repeat=WORD - 2))), 256)), np.uint8)


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    out = np.full(4**WORD, -1, np.int64)
    out[words() @ 4 ** np.arange(WORD - 1, -1, -1)] = np.arange(256)
    return out


def to_words(data: np.ndarray) -> np.ndarray:
    return words()[data].reshape(len(data), -1)


def from_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, erased): unknown letters and words outside the codebook are erased."""
    w = codes.reshape(len(codes), -1, WORD)
    value = _numbers()[np.minimum(w, 3).astype(np.int64) @ 4 ** np.arange(WORD - 1, -1, -1)]
    bad = (w > 3).any(2) | (value < 0)
    return np.where(bad, 0, value).astype(np.uint8), bad


def to_rotation(data: np.ndarray) -> np.ndarray:
    """Six base-3 digits a byte; digit d is the d-th base in order that differs from the base before (A at first)."""
    digits = (data[..., None].astype(np.int64) // 3 ** np.arange(DIGITS - 1, -1, -1) % 3).reshape(len(data), -1)
    out, before = np.zeros(digits.shape, np.uint8), np.zeros(len(data), np.int64)
    for i in range(digits.shape[1]):
        before = digits[:, i] + (digits[:, i] >= before)
        out[:, i] = before
    return out


def from_rotation(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([np.zeros((len(codes), 1), np.int64), codes[:, :-1].astype(np.int64)], axis=1)
    now = codes.astype(np.int64)
    bad = (now > 3) | (before > 3) | (now == before)
    digits = np.where(bad, 0, now - (now > before)).reshape(len(codes), -1, DIGITS)
    value = digits @ 3 ** np.arange(DIGITS - 1, -1, -1)
    erased = bad.reshape(digits.shape).any(2) | (value > 255)
    return np.where(erased, 0, value).astype(np.uint8), erased
