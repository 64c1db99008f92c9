"""Deterministic data: random, text, repetitive, binary or mixed blocks, a function of (seed, block) alone.

    spark.read.format("generated").option("kind", "mixed").option("blocks", 100).option("blockBytes", 4096).load()
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("random", "text", "repetitive", "binary")


def block(kind: str, seed: int, number: int, size: int) -> bytes:
    if kind == "mixed":
        kind = KINDS[number % len(KINDS)]
    rng = np.random.default_rng([seed, number])
    if kind == "random":
        return rng.bytes(size)
    if kind == "text":
        words = np.array([b"strand ", b"read ", b"symbol ", b"group ", b"archive ", b"chunk ", b"marker ", b"parity\n"], object)
        return b"".join(words[rng.integers(0, len(words), size // 5 + 1)])[:size]
    if kind == "repetitive":
        return (rng.bytes(64) * (size // 64 + 1))[:size]
    if kind == "binary":
        return np.arange(number, number + size // 8 + 1, dtype=">u8").tobytes()[:size]
    raise ValueError(f"unknown kind {kind!r}")


class Blocks(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class GeneratorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return "block bigint, data binary"

    def reader(self, schema):
        return GeneratorReader(self.options)


class GeneratorReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.seed = options.get("kind", "mixed"), int(options.get("seed", 0))
        self.blocks, self.size = int(options.get("blocks", 1)), int(options.get("blockBytes", 65_536))
        self.per = int(options.get("blocksPerPartition", 256))

    def partitions(self):
        return [Blocks(a, min(self.blocks, a + self.per)) for a in range(0, self.blocks, self.per)] or [Blocks(0, 0)]

    def read(self, part):
        for i in range(part.first, part.stop):
            yield i, block(self.kind, self.seed, i, self.size)
