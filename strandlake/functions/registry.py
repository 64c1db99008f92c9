"""Kernels as SQL functions: ``register(spark)`` makes them known to spark.sql (the function surface of the engine).

Scalar functions run over Arrow batches: dna_encode, dna_decode, dna_revcomp, gf_mul, gf_inv, rs_parity, rs_repair, frame_parse,
keystream, row_crc32, edit_distance, splitmix64. Table functions: kmers_of(seq, k), extents_of(data, size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import alignment, frames, gf256, reed_solomon
from ..session import prepare

#: Fixed constants of the generator.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def splitmix(x: np.ndarray) -> np.ndarray:
    """One step of splitmix64 on each number (64-bit wrap)."""
    gamma, first, second = (np.uint64(v) for v in SPLITMIX)
    z = x.astype(np.uint64) + gamma
    z = (z ^ z >> np.uint64(30)) * first
    z = (z ^ z >> np.uint64(27)) * second
    return z ^ z >> np.uint64(31)


def _each(values: pa.Array, f, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in values.to_pylist()], kind)


def _bytes_of(seq: str) -> bytes | None:
    codes = frames.codes(seq)
    return None if len(codes) % 4 or (codes > 3).any() else frames.to_bytes(codes[None])[0].tobytes()


def _repair(word: bytes, parity: int) -> dict | None:
    out, ok, fixed = reed_solomon.decode(np.frombuffer(word, np.uint8)[None], parity)
    return {"ok": bool(ok[0]), "word": out[0].tobytes(), "fixed": int(fixed[0])}


def _parse(seq: str, profile: str) -> dict | None:
    layout = frames.PROFILES[profile][0]
    if len(seq) != layout.strand_nt:
        return None
    values, erased, _ = frames.strip(layout, frames.codes(seq)[None])
    p = frames.parse(layout, values, erased)
    return {"ok": bool(p.ok[0]), "kind": int(p.kind[0]), "tag": int(p.tag[0]), "grp": int(p.group[0]), "symbol": int(p.symbol[0]), "payload": p.payload[0].tobytes()}


def _pairwise(a: pa.Array, b: pa.Array, f, kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)


_REPAIRED = pa.struct([("ok", pa.bool_()), ("word", pa.binary()), ("fixed", pa.int32())])
_PARSED = pa.struct([("ok", pa.bool_()), ("kind", pa.int32()), ("tag", pa.int32()), ("grp", pa.int64()), ("symbol", pa.int32()), ("payload", pa.binary())])


def dna_encode(data: pa.Array) -> pa.Array:
    return _each(data, lambda v: frames.sequence(frames.to_codes(np.frombuffer(v, np.uint8)[None])[0]), pa.string())


def dna_decode(seq: pa.Array) -> pa.Array:
    return _each(seq, _bytes_of, pa.binary())


def dna_revcomp(seq: pa.Array) -> pa.Array:
    turned = str.maketrans("ACGTN", "TGCAN")
    return _each(seq, lambda v: v.translate(turned)[::-1], pa.string())


def gf_mul(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: int(gf256.MUL[x, y]) if 0 <= x < 256 and 0 <= y < 256 else None, pa.int32())


def gf_inv(a: pa.Array) -> pa.Array:
    return _each(a, lambda x: int(gf256.INV[x]) if 0 < x < 256 else None, pa.int32())


def rs_parity(data: pa.Array, parity: pa.Array) -> pa.Array:
    return _pairwise(data, parity, lambda d, r: reed_solomon.parity(np.frombuffer(d, np.uint8)[None], r)[0].tobytes(), pa.binary())


def rs_repair(word: pa.Array, parity: pa.Array) -> pa.Array:
    return _pairwise(word, parity, _repair, _REPAIRED)


def frame_parse(seq: pa.Array, profile: pa.Array) -> pa.Array:
    return _pairwise(seq, profile, _parse, _PARSED)


def keystream(variant: pa.Array, span: pa.Array) -> pa.Array:
    return _pairwise(variant, span, lambda v, n: frames.scrambler(n)[v].tobytes() if 0 <= v < frames.VARIANTS else None, pa.binary())


def row_crc32(data: pa.Array) -> pa.Array:
    return _each(data, lambda v: int(frames.crc32(np.frombuffer(v, np.uint8)[None])[0]), pa.int64())


def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: alignment.align(x, y)[0], pa.int32())


def splitmix64(x: pa.Array) -> pa.Array:
    whole = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(splitmix(whole.view(np.uint64)).view(np.int64), pa.int64(), mask=x.is_null().to_numpy(zero_copy_only=False))


SCALARS = {
    dna_encode: "string", dna_decode: "binary", dna_revcomp: "string", gf_mul: "int", gf_inv: "int", rs_parity: "binary", rs_repair: "struct<ok:boolean,word:binary,fixed:int>",
    frame_parse: "struct<ok:boolean,kind:int,tag:int,grp:bigint,symbol:int,payload:binary>", keystream: "binary", row_crc32: "bigint", edit_distance: "int", splitmix64: "bigint",
}


class Kmers:
    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


class Extents:
    def eval(self, data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        for i in range(-(-len(data or b"") // size)):
            yield i, bytes(data[i * size : (i + 1) * size])


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    prepare(spark)
    for f, kind in SCALARS.items():
        spark.udf.register(f.__name__, F.arrow_udf(f, kind))
    spark.udtf.register("kmers_of", F.udtf(Kmers, returnType="pos int, kmer string"))
    spark.udtf.register("extents_of", F.udtf(Extents, returnType="idx int, data binary"))
    return [f.__name__ for f in SCALARS] + ["kmers_of", "extents_of"]
