"""Packed strands: two bits a base, fixed stride, read by record ranges.

A file is: magic "SLPK", version, strand length (u32), count (u64); records;
SHA-256 of all before. Filters on ``record`` are pushed down: only the byte ranges
of the records asked for are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..kernels import frames
from .fastx import files, local

HEAD = struct.Struct(">4sBIQ")
MAGIC, VERSION, ROWS = b"SLPK", 1, 1 << 18


def pack(codes: np.ndarray) -> bytes:
    n = codes.shape[1]
    padded = np.zeros((len(codes), -(-n // 4) * 4), np.uint8)
    padded[:, :n] = codes
    return frames.to_bytes(padded).tobytes()


def header(path: str) -> tuple[int, int]:
    """(strand length, records); raises ValueError for other or torn files."""
    with open(path, "rb") as f:
        head = f.read(HEAD.size)
    if len(head) < HEAD.size or head[:4] != MAGIC:
        raise ValueError(f"{path} is not a packed strand file")
    _, version, nt, n = HEAD.unpack(head)
    if version != VERSION or os.path.getsize(path) != HEAD.size + n * -(-nt // 4) + 32:
        raise ValueError(f"{path} has another version or size")
    return nt, n


def verify(path: str) -> bool:
    """Whether the whole file has the digest that it ends with."""
    h, left = hashlib.sha256(), os.path.getsize(path) - 32
    with open(path, "rb") as f:
        while left:
            block = f.read(min(1 << 20, left))
            h.update(block)
            left -= len(block)
        return f.read() == h.digest()


class Records(InputPartition):
    def __init__(self, path: str, nt: int, first: int, count: int):
        self.path, self.nt, self.first, self.count = path, nt, first, count


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "file string, record bigint, seq string"

    def reader(self, schema):
        return PackedReader(self.options)

    def writer(self, schema, overwrite):
        return PackedWriter(self.options)


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.low, self.high = options["path"], 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("record",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1 - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        out = []
        for path in files(self.path):
            nt, n = header(path)
            stop = min(n, self.high)
            out += [Records(path, nt, a, min(ROWS, stop - a)) for a in range(self.low, stop, ROWS)]
        return out or [Records("", 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        stride = -(-part.nt // 4)
        with open(part.path, "rb") as f:
            f.seek(HEAD.size + part.first * stride)
            data = np.frombuffer(f.read(part.count * stride), np.uint8).reshape(part.count, stride)
        for a in range(0, part.count, 8192):
            codes = frames.to_codes(data[a : a + 8192])[:, : part.nt]
            seqs = [frames.sequence(c) for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(seqs)), pa.array(range(part.first + a, part.first + a + len(seqs)), pa.int64()), pa.array(seqs)], names=["file", "record", "seq"])


class Written(WriterCommitMessage):
    def __init__(self, temporary):
        self.temporary = temporary


class PackedWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = local(options["path"])

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        path, n, nt, h = os.path.join(self.folder, f".part-{uuid.uuid4().hex}"), 0, None, hashlib.sha256()
        body = path + ".body"
        with open(body, "wb") as f:
            for row in iterator:
                codes = frames.codes(row["seq"])
                nt = len(codes) if nt is None else nt
                if len(codes) != nt or (codes > 3).any():
                    raise ValueError("packed strands need one length and the letters A, C, G, T")
                f.write(pack(codes[None]))
                n += 1
        if n:
            with open(path, "wb") as out, open(body, "rb") as f:
                for block in [HEAD.pack(MAGIC, VERSION, nt, n), *iter(lambda: f.read(1 << 20), b"")]:
                    h.update(block)
                    out.write(block)
                out.write(h.digest())
        os.remove(body)
        return Written(path if n else None)

    def commit(self, messages):
        for m in messages:
            if m is not None and m.temporary:
                os.replace(m.temporary, os.path.join(self.folder, f"part-{os.path.basename(m.temporary)[6:]}.slpk"))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)
