"""Streams driven to their end, compared with batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from strandlake.operators import security
from strandlake.sources import register
from strandlake.streaming import detectors, extents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(query):
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def test_extent_stream_store_snapshot_and_ranges(spark, tmp_path):
    data = os.urandom(1050)
    (tmp_path / "s.bin").write_bytes(data)
    load = lambda: spark.readStream.format("extents").option("extentBytes", 100).load(str(tmp_path / "s.bin"))
    folder, check = str(tmp_path / "store"), str(tmp_path / "check")
    run(extents.store(load(), folder, check))
    assert extents.current(spark, folder).count() == 10
    (tmp_path / "s.bin").write_bytes(data + os.urandom(100))
    run(extents.store(load(), folder, check))
    now = extents.current(spark, folder)
    assert now.count() == 11 and extents.current(spark, folder, at=0).count() == 10
    got = b"".join(bytes(r["data"]) for r in extents.read_range(now, 100, 250, 333).orderBy("idx").collect())
    assert got == data[250:583] and extents.scrub(now).count() == 0
    bad = now.withColumn("data", F.when(F.col("idx") == 3, F.lit(b"x")).otherwise(F.col("data")))
    assert [r["idx"] for r in extents.scrub(bad).collect()] == [3]


def test_fold_equals_batch_rules(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'")
    rule = detectors.Rule("r", 3 * 86_400, 3)
    batch = security.once_per_window(security.bursts(events, ["user_id"], "ts", rule.seconds, rule.least), ["user_id"], "ts", rule.seconds)
    want = {r["event_id"] for r in batch.collect()}
    got = set()
    by = {}
    for r in events.collect():
        by.setdefault(r["user_id"], []).append((int(r["ts"].timestamp() * 1_000_000), "", r["event_id"]))
    for rows in by.values():
        got |= {f[0] for f in detectors.fold(rule, [], [], None, sorted(rows))[3]}
    assert got == want and want


def test_stream_of_findings(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = detectors.Rule("r", 3 * 86_400, 3)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = detectors.detect(stream, rule, "user_id", value="props")
    query = found.writeStream.format("memory").queryName("findings").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run(query)
    want = security.once_per_window(security.bursts(events, ["user_id"], "ts", rule.seconds, rule.least), ["user_id"], "ts", rule.seconds)
    assert sorted(r["event_id"] for r in spark.table("findings").collect()) == sorted(r["event_id"] for r in want.collect())


def test_replay_and_session_windows(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:05:00"), (3, "b", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "id bigint, nonce string, t string").select("id", "nonce", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id bigint, nonce string, ts timestamp").parquet(str(tmp_path / "in"))
    run(detectors.first_seen(stream(), ["nonce"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start())
    assert sorted(r["nonce"] for r in spark.table("seen").collect()) == ["a", "b"]
    for f, n in ((detectors.session_counts, "sessions"), (detectors.tumbling_counts, "tumbling")):
        run(f(stream(), "nonce").writeStream.format("memory").queryName(n).outputMode("complete").option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start())
    assert {r["nonce"]: r["n"] for r in spark.table("sessions").collect()} == {"a": 2, "b": 1}
    assert spark.table("tumbling").count() == 3
