"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The library's model works on strings in which each byte is one character (a
fixed table of 256). A vocabulary given as tiktoken ranks becomes such a model:
every way to join two tokens into a third is a merge with the third's rank.

Texts are cut into the matches of the pattern and each match is encoded by
itself. The pattern always cuts before a space that stands between other
characters, so the texts of a slice of rows (bounded in bytes) are split at
spaces at once, each distinct run is encoded once, and the ids are gathered
back. A run of Latin letters is one match; other matches are kept (bounded).

A tokenizer file's added tokens are found in texts as the library finds them
(``special``, on by default); with False their strings are ordinary text. Rank
files have none.

``offsets`` places each token in the text by characters: its bytes are counted
and mapped to characters; a token that holds only a part of a character covers
the whole character. Decoding reverses the byte table and joins bytes before it
decodes UTF-8, so characters split over tokens come back whole.

Defined results: a null text is empty and has no tokens. Texts of any length are
encoded whole. Repeated rows are encoded alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Matches that a worker keeps; characters up to which one is kept; bytes of a slice of rows; runs gathered at a time.
KEPT, KEPT_CHARS, SLICE, GATHERED = 50_000, 24, 1 << 24, 1 << 17
#: A space after other white space, or a separator on which libraries differ: such texts are cut by the pattern itself.
ODD = r"[\t-\r\x{85}\p{Z}] |[\x1c-\x1f]"


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """Character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One vocabulary: encode to ids, decode to bytes, offsets."""

    def __init__(self, path: str, pattern: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer, models

        table = byte_characters()
        self._latin = {b: table[b] for b in range(256)}
        self._space = table[32]
        self._added: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(table)}
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = not special
            added = json.load(open(path, encoding="utf-8"))["added_tokens"]
            names = {t["content"] for t in added}
            if special:
                if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
                    raise ValueError("added tokens that look at their surroundings are not supported")
                self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.tokens = {i: bytes(back[c] for c in t) if t not in names else t.encode() for t, i in vocab.items()}
        else:
            ranks = read_ranks(path)
            name = {t: "".join(table[b] for b in t) for t in ranks}
            merges = []
            for token in sorted(ranks, key=ranks.get):
                ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
                merges += [(name[a], name[b]) for a, b in sorted(ways, key=lambda w: (ranks[w[0]], ranks[w[1]]))]
            self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
            self.tokens = {r: t for t, r in ranks.items()}
        self.model = self.tokenizer.model
        self._find = regex.compile(pattern).findall
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")").split if self._added else None
        self._words = r" ?\p{L}+" in pattern.split("|")
        self._pieces: dict[str, bytes] = {}

    def _ids(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _mapped(self, piece: str) -> str:
        return piece.encode("utf-8", "replace").decode("latin-1").translate(self._latin)

    def _piece(self, piece: str) -> bytes:
        out = self._pieces.get(piece)
        if out is None:
            out = self._ids(self._mapped(piece))
            if len(piece) <= KEPT_CHARS:
                if len(self._pieces) >= KEPT:
                    self._pieces.clear()
                self._pieces[piece] = out
        return out

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self._piece, self._find(text)))

    def _odd(self, text: str) -> bytes:
        """A text that can't be cut at its spaces, or that holds added tokens."""
        if self._split is None:
            return self._matches(text)
        return b"".join(self._added.get(x) or self._matches(x) for x in self._split(text) if x)

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each) of runs, each with a space before it."""
        ids, ends, tokenize = array("I"), array("q"), self.model.tokenize
        for run in runs:
            if self._words and run.isalpha() and (run.isascii() or max(run) < "\u0250"):
                ids.extend([t.id for t in tokenize(self._space + (run if run.isascii() else self._mapped(run)))])
            else:
                ids.frombytes(self._matches(" " + run))
            ends.append(len(ids))
        return np.frombuffer(ids, np.uint32), np.frombuffer(ends, np.int64)

    def encode_slice(self, texts: pa.Array):
        """The ids of each text of an array without nulls in turn. Runs are encoded for the whole slice, and gathered for
        some texts at a time."""
        odd = pc.match_substring_regex(texts, ODD)
        for t in self._added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        whole = {int(i): self._odd(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if whole else texts, " ")
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        runs = lists.values.slice(lists.offsets[0].as_py(), int(at[-1]))
        firsts = runs.take(pa.array(at[:-1])).to_pylist()  # a text's first run has no space before it
        coded = runs.dictionary_encode()
        del lists, runs
        ids, ends = self._runs(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        lo = 0
        while lo < len(firsts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GATHERED, side="right")) - 1)
            own = which[at[lo] : at[hi]]
            n = sizes[own]
            n[at[lo:hi] - at[lo]] = 0
            stop = np.cumsum(n)
            place = np.repeat(starts[own] - stop + n, n)
            place += np.arange(len(place))
            out, last = ids[place], 0
            for i, end in zip(range(lo, hi), stop[at[lo + 1 : hi + 1] - at[lo] - 1].tolist(), strict=True):
                first = whole[i] if i in whole else self._matches(firsts[i])
                yield np.concatenate([np.frombuffer(first, np.uint32), out[last:end]])
                last = end
            lo = hi

    def encode_all(self, texts: pa.Array):
        """The ids of each text in turn; nulls are empty."""
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            base = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
            yield from self.encode_slice(texts.slice(first, last - first))
            pa.default_memory_pool().release_unused()
            first = last

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))

    def offsets(self, text: str, ids) -> list[tuple[int, int]]:
        """(first character, character after the last) of each token."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.tokens[i]) for i in np.asarray(ids).tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return [(int(character[a]), int(character[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, special: bool = True) -> Codec:
    return Codec(path, pattern, special)


def encode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """id, ids (array<int>) and with ``offsets`` starts, ends (array<int>) of each row."""
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = list(c.encode_all(b.column(1)))
            cols = [b.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))]
            if offsets:
                at = [c.offsets(t or "", x) for t, x in zip(b.column(1).to_pylist(), ids, strict=True)]
                cols += [pa.array([[o[k] for o in x] for x in at], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "ids"] + ["starts", "ends"] * offsets
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>{extra}")


def decode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id, data (binary), text (UTF-8, with replacement characters where ids end amid a character)."""
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            data = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data])], names=[id_column, "data", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids).mapInArrow(run, f"`{id_column}` {kind}, data binary, text string")


def digests(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass."""
    def run(batches):
        c = codec(path, pattern)
        decimal = [str(i) for i in range(max(c.tokens, default=-1) + 1)].__getitem__
        for b in batches:
            rows = []
            for found in c.encode_all(b.column(1)):
                ids = found.tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(c.tokens.__getitem__, ids))).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
