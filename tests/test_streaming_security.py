"""Session binding, risk and replay protection as streams; scanning a stream of reads by tag."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import security as batch
from strandlake.plans import codec
from strandlake.streaming import security

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def through(spark, rows, make, name, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()
    return spark.table(name).collect()


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_sessions_bound_as_in_batch(spark, tmp_path):
    rows = events(spark).select(F.col("props").alias("session"), F.col("user_id").cast("string").alias("principal"), "ts", "event_id")
    got = through(spark, rows, security.session_changes, "bound", tmp_path)
    want = batch.session_changes(rows, "session", "principal", "ts").select("event_id", "principal", "bound").collect()
    assert {(r["event_id"], r["principal"], r["bound"]) for r in got} == set(map(tuple, want)) and want


def test_risk_as_in_batch(spark, tmp_path):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "MEDIUM").when(kind == "signup", "HIGH").otherwise("LOW")
    rows = events(spark).select(F.col("user_id").cast("string").alias("subject"), severity.alias("severity"), F.timestamp_micros((F.unix_micros("ts") / 96).cast("bigint")).alias("ts"), "event_id")
    got = through(spark, rows, security.risk, "risk", tmp_path)
    want = batch.risk(rows, ["subject"], "ts", "severity").select("event_id", "score", "level").collect()
    assert {(r["event_id"], r["score"], r["level"]) for r in got} == set(map(tuple, want))
    assert len({r["level"] for r in got}) >= 3


def test_replay_guard(spark, tmp_path):
    n = "n" * 16
    rows = [(0, n + "a", 0, 0), (1, n + "a", 10, 10), (2, n + "b", 20, 200), (3, n + "c", 30, 150), (4, "short", 40, 40), (5, n + "a", 700, 700), (6, None, 50, 50), (7, n + "b", 60, 60)]
    df = spark.createDataFrame(rows, "event_id bigint, nonce string, now bigint, said bigint").select("event_id", "nonce", F.timestamp_seconds(F.col("now") + 1_700_000_000).alias("ts"), F.timestamp_seconds(F.col("said") + 1_700_000_000).alias("claimed"))
    got = {r["event_id"]: r["refused"] for r in through(spark, df, lambda s: security.replay_guard(s, parts=3), "replays", tmp_path)}
    assert got == {0: None, 1: "replay", 2: "stale_request", 3: None, 4: "malformed_nonce", 5: None, 6: "malformed_nonce", 7: None}


def test_reads_by_tag_and_progress(spark, tmp_path):
    listener = security.Progress()
    spark.streams.addListener(listener)
    try:
        files = spark.createDataFrame([(i, bytearray(b"%d" % i * 300)) for i in (1, 2)], "id bigint, data binary")
        codec.encode(files, "id", F.col("data")).select("seq", F.lit(None).cast("binary").alias("qual")).write.parquet(str(tmp_path / "in"))
        query = security.by_tag(spark.readStream.schema("seq string, qual binary").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination(120)
        assert query.exception() is None
        found = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*"))
        assert {r["tag"]: r["n"] for r in found.groupBy("tag").agg(F.count("*").alias("n")).collect()} == {1: 8 + 16, 2: 8 + 16}
    finally:
        spark.streams.removeListener(listener)
