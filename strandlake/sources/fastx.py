"""FASTA, FASTQ and plain sequence files: a splittable reader and an atomic writer.

    spark.read.format("fastx").load("file:///shared/reads.fastq")
    df.write.format("fastx").mode("append").save("file:///shared/out")      # columns name, seq[, qual]

Files must lie in a folder that all executors share. The reader cuts files into
byte ranges; a range owns the records that begin in it. A file ending in .gz can't
be cut and is one range. Options: rangeBytes, kind, maxReads (of each file, in
order), maxLength (a longer record raises). In FASTQ a record begins at a line "@..." whose third line begins with "+" and whose second and
fourth lines have equal lengths, which no quality line can imitate at both ends.
For stores that only Spark reads, ``lines`` parses the text source instead.
"""

from __future__ import annotations

import glob
import gzip
import os
import sys
import uuid
from itertools import islice
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, seq string, qual binary, invalid boolean"
SUFFIXES = {".fa": "fasta", ".fasta": "fasta", ".fq": "fastq", ".fastq": "fastq", ".txt": "plain", ".seq": "plain"}


def local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def files(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(os.path.join(path, "*")) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


def opened(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def detect(path: str) -> str:
    """fasta, fastq or plain, by the first character that is not white space; packed files are refused."""
    with opened(path) as f:
        head = f.read(4096).lstrip()
    if head[:4] == b"SLPK":
        raise ValueError(f"{path} holds packed strands; read it with format packed")
    return {b">": "fasta", b"@": "fastq"}.get(head[:1], "plain")


class Range(InputPartition):
    def __init__(self, path: str, kind: str, start: int, stop: int):
        self.path, self.kind, self.start, self.stop = path, kind, start, stop


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options)

    def writer(self, schema, overwrite):
        return FastxWriter(self.options, [f.name for f in schema.fields])


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", 64 << 20))
        self.kind = options.get("kind")
        self.most, self.longest = (int(options.get(n, 0)) or None for n in ("maxReads", "maxLength"))

    def partitions(self):
        out = []
        for f in files(self.path):
            n, kind = os.path.getsize(f), self.kind or detect(f)
            # a packed file, or the first reads of one, are read from the front
            whole = f.endswith(".gz") or self.most is not None
            out += [Range(f, kind, 0, sys.maxsize)] if whole and n else [Range(f, kind, a, min(n, a + self.size)) for a in range(0, n, self.size)]
        return out or [Range("", "plain", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        with opened(part.path) as f:
            records = {"fasta": _fasta, "fastq": _fastq, "plain": _plain}[part.kind](f, part.start, part.stop)
            for name, seq, qual in islice(records, self.most):
                if self.longest is not None and len(seq) > self.longest:
                    raise ValueError(f"{part.path}: a record has more than {self.longest} letters")
                text = seq.decode("ascii", "replace").upper()
                yield name, text, qual, bool(text.translate({65: None, 67: None, 71: None, 84: None, 78: None}))


def _line_start(f, start: int) -> None:
    """Stand at the first line that begins at ``start`` or later."""
    f.seek(max(0, start - 1))
    if start:
        f.readline()


def _plain(f, start, stop):
    _line_start(f, start)
    while f.tell() < stop and (line := f.readline()):
        if s := line.strip():
            yield None, s, None


def _fasta(f, start, stop):
    _line_start(f, start)
    name, parts = None, []
    while True:
        at = f.tell()
        line = f.readline()
        if not line or line.startswith(b">"):
            if name is not None:
                yield name, b"".join(parts), None
            if not line or at >= stop:
                return
            name, parts = line[1:].strip().decode("utf-8", "replace"), []
        elif name is not None:
            parts.append(line.strip())


def _fastq(f, start, stop):
    _line_start(f, start)
    while f.tell() < stop:
        at = f.tell()
        record = [f.readline() for _ in range(4)]
        if not record[0]:
            return
        head, seq, plus, qual = (x.rstrip(b"\r\n") for x in record)
        if head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual):
            yield head[1:].decode("utf-8", "replace"), seq, bytes(max(0, q - 33) for q in qual)
        else:
            f.seek(at)
            f.readline()


class Written(WriterCommitMessage):
    def __init__(self, temporary: str | None):
        self.temporary = temporary


class FastxWriter(DataSourceWriter):
    """Each task writes a hidden file; commit renames them all, abort removes them."""

    def __init__(self, options, names):
        self.folder, self.names = local(options["path"]), names
        self.kind = options.get("kind", "fastq" if "qual" in names else "fasta")
        if self.kind == "fastq" and "qual" not in names:
            raise ValueError("FASTQ needs a column qual")

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f".part-{uuid.uuid4().hex}")
        n = 0
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                r = row.asDict()
                n += 1
                if self.kind == "fastq":
                    f.write(f"@{r.get('name') or n}\n{r['seq']}\n+\n{''.join(chr(q + 33) for q in r['qual'])}\n")
                elif self.kind == "fasta":
                    f.write(f">{r.get('name') or n}\n{r['seq']}\n")
                else:
                    f.write(r["seq"] + "\n")
        if not n:
            os.remove(path)
        return Written(path if n else None)

    def commit(self, messages):
        suffix = {"fasta": "fa", "fastq": "fq", "plain": "txt"}[self.kind]
        for m in messages:
            if m is not None and m.temporary:
                os.replace(m.temporary, os.path.join(self.folder, f"part-{os.path.basename(m.temporary)[6:]}.{suffix}"))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of FASTA files in any store: the text source cut at ">" instead of line ends."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.length("value") > 0)
    body = F.regexp_replace("value", "^>", "")
    return raw.select(F.trim(F.regexp_extract(body, "^([^\\n]*)", 1)).alias("name"), F.upper(F.regexp_replace(F.regexp_replace(body, "^[^\\n]*", ""), "\\s", "")).alias("seq"))


#: Prefix of strand names (fixed value of the format).
PREFIX = "vnx4"


def label(tag, kind, grp, symbol, prefix: str = PREFIX):
    """Name of a strand record: prefix|tag|kind|group|symbol, the tag as four hexadecimal digits."""
    return F.concat_ws("|", F.lit(prefix), F.lower(F.lpad(F.hex(tag), 4, "0")), kind.cast("string"), grp.cast("string"), symbol.cast("string"))


def parse_label(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds tag, kind, grp, symbol of strand names (null for others)."""
    parts = F.split(name, "\\|")
    good = F.size(parts) == 5
    return df.withColumns({
        "tag": F.when(good, F.conv(F.get(parts, F.lit(1)), 16, 10).cast("int")), "kind": F.when(good, F.get(parts, F.lit(2)).cast("int")),
        "grp": F.when(good, F.get(parts, F.lit(3)).cast("bigint")), "symbol": F.when(good, F.get(parts, F.lit(4)).cast("int")),
    })
