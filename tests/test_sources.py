"""Data sources: splits, round trips, pushdown, streams."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import fastx, packed, register
from strandlake.sources.generator import block


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    register(spark)


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_fastx_splits_keep_every_record(spark, tmp_path, size):
    random.seed(1)
    seqs = ["".join(random.choice("ACGT") for _ in range(random.randint(1, 80))) for _ in range(60)]
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{s}\n+\n{''.join(random.choice('@+I5') for _ in s)}\n" for i, s in enumerate(seqs)))
    (tmp_path / "b.fa").write_text("".join(f">f{i}\n{s[:20]}\n{s[20:]}\n" for i, s in enumerate(seqs)))
    (tmp_path / "c.txt").write_text("\n".join(seqs) + "\n")
    for name, first in (("a.fq", "r"), ("b.fa", "f"), ("c.txt", None)):
        rows = spark.read.format("fastx").option("rangeBytes", size).load(str(tmp_path / name)).collect()
        if first:
            assert {r["name"]: r["seq"] for r in rows} == {f"{first}{i}": s for i, s in enumerate(seqs)} and len(rows) == len(seqs)
        else:
            assert sorted(r["seq"] for r in rows) == sorted(seqs)


def test_fastx_write_and_invalid(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", bytearray([30] * 4)), ("b", "AXGT", bytearray([2] * 4))], "name string, seq string, qual binary")
    df.write.format("fastx").mode("append").save(str(tmp_path / "out"))
    rows = {r["name"]: (r["seq"], bytes(r["qual"]), r["invalid"]) for r in spark.read.format("fastx").load(str(tmp_path / "out")).collect()}
    assert rows == {"a": ("ACGT", bytes([30] * 4), False), "b": ("AXGT", bytes([2] * 4), True)}


def test_fasta_by_text_source_and_labels(spark, tmp_path):
    name = f"{fastx.PREFIX}|7dfc|1|0|3"
    (tmp_path / "x.fa").write_text(f">{name}\nAC\nGT\n>other\nTTTT\n")
    rows = fastx.parse_label(fastx.lines(spark, str(tmp_path / "x.fa"))).orderBy("seq").collect()
    assert [(r["name"], r["seq"], r["tag"], r["symbol"]) for r in rows] == [(name, "ACGT", 0x7DFC, 3), ("other", "TTTT", None, None)]
    made = spark.createDataFrame([(0x7DFC, 1, 0, 3)], "tag int, kind int, grp int, symbol int").select(fastx.label(F.col("tag"), F.col("kind"), F.col("grp"), F.col("symbol")).alias("l"))
    assert made.first()["l"] == name


def test_packed_round_trip_pushdown_and_digest(spark, tmp_path):
    random.seed(2)
    seqs = ["".join(random.choice("ACGT") for _ in range(31)) for _ in range(200)]
    spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(1).write.format("packed").mode("append").save(str(tmp_path / "p"))
    path = next((tmp_path / "p").glob("*.slpk"))
    assert packed.header(str(path)) == (31, 200) and packed.verify(str(path))
    df = spark.read.format("packed").load(str(tmp_path / "p"))
    assert [r["seq"] for r in df.orderBy("record").collect()] == seqs
    assert [r["seq"] for r in df.where("record >= 7 AND record < 9").orderBy("record").collect()] == seqs[7:9]
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(bytes(data))
    assert not packed.verify(str(path))
    with pytest.raises(ValueError):
        packed.header(__file__)


def test_generator_is_deterministic(spark):
    df = spark.read.format("generated").option("kind", "mixed").option("blocks", 10).option("blockBytes", 100).option("blocksPerPartition", 3).load()
    assert [bytes(r["data"]) for r in df.orderBy("block").collect()] == [block("mixed", 0, i, 100) for i in range(10)]
