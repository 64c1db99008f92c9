"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from strandlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert rows(names, got) == rows(names, want)


def test_channel_reads_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, catalog.channel_reads(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, catalog.channel_reads(spark, SF).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_longest_runs_without_letters(spark):
    plan = catalog.homopolymer_runs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "replace" not in plan
