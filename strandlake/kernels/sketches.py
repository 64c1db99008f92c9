"""MD5 of many short words at once, and the least word hashes of a text (P31, P32 rows)."""

from __future__ import annotations

import hashlib

import numpy as np

_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Words hashed at once (their state stays in the cache), and letters that a call spreads out as words at once.
LANES, LETTERS = 1 << 13, 1 << 18
_TURNED = np.arange(256, dtype=np.uint8)
_TURNED[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
_LETTERS = str.maketrans("ACGT", "TGCA")
NONE = np.iinfo(np.int64).max


def hash60(words: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of each row of bytes (n, k); k is at most 55, so that a row is one block."""
    n, k = words.shape
    if k > 55:
        return np.array([_hash(w.tobytes()) for w in words], np.int64)
    out = np.empty(n, np.int64)
    for first in range(0, n, LANES):
        part = words[first : first + LANES]
        block = np.zeros((len(part), 64), np.uint8)
        block[:, :k], block[:, k] = part, 0x80
        said = np.ascontiguousarray(block[:, : 4 * (k // 4 + 1)].view("<u4").T)
        out[first : first + len(part)] = _digest(said, 8 * k)
    return out


def _digest(said: np.ndarray, bits: int) -> np.ndarray:
    """``said``: the words of the block that are not zero, without the length."""
    n = said.shape[1]
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = _WORD[i]
        np.add(f, a, out=f)
        np.add(f, np.uint32((int(_SINE[i]) + (bits if w == 14 else 0)) & 0xFFFFFFFF), out=f)
        if w < len(said):
            np.add(f, said[w], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=t), np.right_shift(f, np.uint32(32 - _TURN[i]), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    high, low = (np.add(x, np.uint32(v)).byteswap().astype(np.uint64) for x, v in zip((a, b), _START, strict=False))
    return ((high << np.uint64(28)) | (low >> np.uint64(4))).astype(np.int64)


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big") >> 4


def _plain(text: str, k: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, turned) of a text with letters of several bytes, word by word."""
    words = [text[i : i + k] for i in range(len(text) - k + 1)]
    least = [min(w, w.translate(_LETTERS)[::-1], key=str.encode) if both else w for w in words]
    return np.array([_hash(w.encode()) for w in least], np.int64), np.array([x != w for x, w in zip(least, words, strict=True)], bool)


def _of_bytes(text: np.ndarray, k: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, turned) of every word of ``k`` neighbouring bytes."""
    words = np.lib.stride_tricks.sliding_window_view(text, k)
    turned = np.zeros(len(words), bool)
    if both:
        back = np.ascontiguousarray(_TURNED[words[:, ::-1]])
        own = np.ascontiguousarray(words)
        turned = back.view(f"S{k}")[:, 0] < own.view(f"S{k}")[:, 0]
        words = np.where(turned[:, None], back, own)
    return hash60(words), turned


def least(texts: list[str | None], k: int, slots: int, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each text and slot (hash modulo ``slots``) the least 2 * hash + turned of its words of ``k`` letters, NONE where there is none.

    With ``both`` a word counts as the lesser of itself and its reverse complement; turned tells which.
    """
    out = np.full(len(texts) * slots, NONE, np.int64)

    def add(rows: np.ndarray, hashes: np.ndarray, turned: np.ndarray) -> None:
        np.minimum.at(out, rows * slots + hashes % slots, 2 * hashes + turned)

    def flush(held: list[tuple[int, bytes]]) -> None:
        text = np.frombuffer(b"".join(t for _, t in held), np.uint8)
        if len(text) < k:
            return
        sizes = np.array([len(t) for _, t in held])
        hold = np.repeat(np.arange(len(held)), sizes)
        hashes, turned = _of_bytes(text, k, both)
        whole = hold[: len(hashes)] == hold[k - 1 :]  # words that end in the text in which they begin
        add(np.array([r for r, _ in held])[hold[: len(hashes)][whole]], hashes[whole], turned[whole])

    held: list[tuple[int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        if text is None or len(text) < k:
            continue
        if not text.isascii():
            hashes, turned = _plain(text, k, both)
            add(np.full(len(hashes), row), hashes, turned)
            continue
        data = text.encode()
        for i in range(0, len(data) - k + 1, LETTERS):  # a long text in pieces that share k - 1 letters
            held.append((row, data[i : i + LETTERS + k - 1]))
            size += len(held[-1][1])
            if size >= LETTERS:
                flush(held)
                held, size = [], 0
    if held:
        flush(held)
    return out.reshape(len(texts), slots)
