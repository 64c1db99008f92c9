"""Compression and authenticated encryption of chunks (P20, P21)."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, StructField, StructType


def derive(master: bytes, salt: bytes, label: str, length: int = 32) -> bytes:
    """HKDF with SHA-256."""
    if len(master) != 32:
        raise ValueError("the master key has 32 bytes")
    key, out, block = hmac.new(salt, master, hashlib.sha256).digest(), b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(key, block + label.encode() + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def passphrase_key(passphrase: str, salt: bytes, n: int = 1 << 14, r: int = 8, p: int = 1) -> bytes:
    if not passphrase:
        raise ValueError("empty passphrase")
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=r, p=p, dklen=32, maxmem=256 * n * r)


def _bound(domain: int, index: Column) -> Column:
    return F.concat(F.lit(domain.to_bytes(4, "big")), F.unhex(F.lpad(F.hex(index.cast("bigint")), 16, "0")))


def seal(data: Column, key: bytes, domain: int, index: Column, archive: bytes) -> Column:
    """AES-256-GCM with the nonce (domain, index), bound to the archive; ciphertext and tag without the nonce."""
    nonce = _bound(domain, index)
    sealed = F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat(F.lit(archive), nonce))
    return F.substring(sealed, 13, 2_000_000_000)


def unseal(sealed: Column, key: bytes, domain: int, index: Column, archive: bytes) -> Column:
    """Inverse; null where authentication fails."""
    nonce = _bound(domain, index)
    return F.try_aes_decrypt(F.concat(nonce, sealed), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit(archive), nonce))


@F.arrow_udf(StructType([StructField("codec", ByteType()), StructField("data", BinaryType())]))
def compress(data: pa.Array) -> pa.Array:
    """zstd where it makes the chunk smaller (codec 1), else the chunk itself (codec 0)."""
    zstd = pa.Codec("zstd")
    out = []
    for x in data.to_pylist():
        small = None if x is None else zstd.compress(x, asbytes=True)
        out.append((0, x) if small is None or len(small) >= len(x) else (1, small))
    return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.int8()), pa.array([o[1] for o in out], pa.binary())], names=["codec", "data"])


@F.arrow_udf(BinaryType())
def decompress(codec: pa.Array, data: pa.Array, size: pa.Array) -> pa.Array:
    """The chunk of ``size`` bytes; null where the bytes do not decompress to that size."""
    zstd, out = pa.Codec("zstd"), []
    for c, x, n in zip(codec.to_pylist(), data.to_pylist(), size.to_pylist(), strict=True):
        try:
            y = x if c == 0 else zstd.decompress(x, decompressed_size=n, asbytes=True)
        except (OSError, pa.ArrowInvalid):
            y = None
        out.append(y if y is not None and len(y) == n else None)
    return pa.array(out, pa.binary())
