"""Token counts under a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character, longest first, that is by the place where they begin. The pass keeps
for each character the best score and the number of pieces of the best path; no
path is stored. Ties go as in the tokenizers library: the earliest start wins,
and a character without a piece of its own costs the least score less ten and
counts as its UTF-8 bytes (byte fallback).

Each space (or "▁") begins a word; "▁" stands before it and before the text. Words are
counted apart and kept, bounded, in each worker.

Defined results: null and empty texts have no tokens; any length is counted
whole; repeated rows are counted each; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KEPT, KEPT_CHARS = 200_000, 48
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self._kept: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of the best path over ``text``. Only as many places are kept as the longest piece reaches back."""
        size = self.longest + 1
        score, count = [0.0] * size, [0] * size
        matches = self.pieces.iter(text)
        match = next(matches, None)
        for i, c in enumerate(text):
            best, pieces = None, 0
            while match is not None and match[0] == i:
                length, s = match[1]
                at = (i + 1 - length) % size
                a = score[at] + s
                if best is None or a > best:
                    best, pieces = a, count[at] + 1
                match = next(matches, None)
            if c not in self.single:
                a = score[i % size] + self.unknown
                if best is None or a > best:
                    best, pieces = a, count[i % size] + len(c.encode("utf-8", "replace"))
            score[(i + 1) % size], count[(i + 1) % size] = best, pieces
        return count[len(text) % size]

    def _new(self, word: str) -> int:
        n = self.word("▁" + word)
        if len(word) <= KEPT_CHARS:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace("▁", " ").split(" ")  # the mark itself begins a word too
        if words[0] == "":
            del words[0]
        get, new = self._kept.get, self._new
        return sum([n if (n := get(w)) is not None else new(w) for w in words])


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def count(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_bytes of each row."""
    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.text(t) for t in texts], pa.int64()), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())], names=[id_column, "n_tokens", "n_bytes"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, n_bytes long")
