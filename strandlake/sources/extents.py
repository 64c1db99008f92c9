"""A growing file as a stream of extents of fixed size (the last one only with option final=true).

    spark.readStream.format("extents").option("extentBytes", 1048576).load("file:///shared/stream.bin")
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .fastx import local


class Extents(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class ExtentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extents"

    def schema(self) -> str:
        return "idx bigint, data binary"

    def reader(self, schema):
        return ExtentReader(self.options)

    def streamReader(self, schema):
        return ExtentStream(self.options)


class _Extents:
    def __init__(self, options):
        self.path, self.size = local(options["path"]), int(options.get("extentBytes", 1 << 20))
        self.per, self.final = int(options.get("extentsPerPartition", 64)), options.get("final", "false") == "true"

    def count(self) -> int:
        n = os.path.getsize(self.path)
        return -(-n // self.size) if self.final else n // self.size

    def split(self, first: int, stop: int):
        return [Extents(a, min(stop, a + self.per)) for a in range(first, stop, self.per)] or [Extents(0, 0)]

    def rows(self, part):
        if part.stop > part.first:
            with open(self.path, "rb") as f:
                f.seek(part.first * self.size)
                for i in range(part.first, part.stop):
                    yield i, f.read(self.size)


class ExtentReader(_Extents, DataSourceReader):
    def partitions(self):
        return self.split(0, self.count())

    def read(self, part):
        return self.rows(part)


class ExtentStream(_Extents, DataSourceStreamReader):
    def initialOffset(self):
        return {"extent": 0}

    def latestOffset(self):
        return {"extent": self.count()}

    def partitions(self, start, end):
        return self.split(start["extent"], end["extent"])

    def read(self, part):
        return self.rows(part)

    def commit(self, end):
        pass
