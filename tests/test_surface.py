"""Formats, SQL functions, folders, packages, studies, scenarios, ordered folds, the command line."""

import datetime
import hashlib
import hmac
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions import registry, text
from strandlake.operators import archive, experiments, ordered, security, taxonomy
from strandlake.plans import archives, packages, scenarios, studies
from strandlake.sources import folders, register


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column.alias("x")).first()["x"]


def test_small_formats(spark):
    x = F.col("x")
    for given, want in {"64MiB": 64 << 20, "1.5 kb": 1536, "300": 300, ".5B": 0, " 2 TB ": 2 << 40, "": None, "1XB": None, "-1": None, "1 2": None}.items():
        assert one(spark, text.size_bytes(x), x=given) == want, given
    for given, want in {"a/b": None, "": "length", "/a": "unsafe", "a\\b": "unsafe", "a//b": "component", "a/..": "component", ".": "component", "a\tb": "control", "é" * 2049: "length", "é" * 2048: None}.items():
        assert one(spark, text.path_fault(x), x=given) == want, given
    assert one(spark, text.utc_stamp(x), x="2024-02-29T23:59:59.5Z") == datetime.datetime(2024, 2, 29, 23, 59, 59, 500000)
    for bad in ("2023-02-29T00:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "x"):
        assert one(spark, text.utc_stamp(x), x=bad) is None
    keys = ["1.2.0", "1.10", "1.10.0-rc", "1.10.0", "2", "x", "1.2.0-a"]
    rows = spark.createDataFrame([(k,) for k in keys], "v string").select("v", text.version_key(F.col("v")).alias("k")).where("k IS NOT NULL").orderBy("k")
    assert [r["v"] for r in rows.collect()] == ["1.2.0-a", "1.2.0", "1.10", "1.10.0-rc", "1.10.0", "2"]
    assert one(spark, text.sweep_points(x), x="mixed=a:0.1+b:0.2") == [[("a", 0.1), ("b", 0.2)]] and one(spark, text.sweep_points(x), x="a=1.1") is None and one(spark, text.sweep_points(x), x="a") is None
    assert one(spark, text.cigar_length(text.cigar_runs(x), "=D"), x="10=2X3D1I") == 13


def test_strict_documents():
    assert text.strict_document('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[" * 99 + "]" * 99, '{"x": "' + "y" * 11 + '"}', "[1, 2, 3, 4, 5, 6]", "{", "[" * 200_000):
        with pytest.raises(ValueError):
            text.strict_document(bad, depth=8, nodes=6, longest=10)
    assert text.canonical({"b": 1, "a": [True, "é"]}) == '{"a":[true,"é"],"b":1}'
    with pytest.raises(ValueError):
        text.canonical(float("nan"))
    doc = {"a": {"b": 1}, "c": 2}
    assert text.with_value(doc, "a.b", 5) == {"a": {"b": 5}, "c": 2} and doc["a"]["b"] == 1
    with pytest.raises(KeyError):
        text.with_value(doc, "a.x", 1)


def test_sql_functions(spark):
    names = registry.register(spark)
    assert len(names) == 14
    row = spark.sql("SELECT dna_encode(x'1B00') a, dna_decode('ACGTAAAA') b, dna_revcomp('AACG') c, gf_mul(7, gf_inv(7)) d, gf_inv(0) e, row_crc32(cast('123456789' AS binary)) f, edit_distance('kitten', 'sitting') g, dna_decode('ACG') h, dna_encode(NULL) i").first()
    assert tuple(row) == ("ACGTAAAA", bytearray(b"\x1b\x00"), "CGTT", 1, None, 0xCBF43926, 3, None, None)
    fixed = spark.sql("WITH w AS (SELECT concat(x'0102030405', rs_parity(x'0102030405', 4)) AS w) SELECT rs_repair(concat(x'FF', substring(w, 2)), 4) AS r, w FROM w").first()
    assert fixed["r"]["ok"] and fixed["r"]["word"] == fixed["w"] and fixed["r"]["fixed"] == 1
    assert [tuple(r) for r in spark.sql("SELECT * FROM kmers_of('ACGT', 3)").collect()] == [(0, "ACG"), (1, "CGT")]
    assert [tuple(r) for r in spark.sql("SELECT idx, hex(data) FROM extents_of(x'010203', 2)").collect()] == [(0, "0102"), (1, "03")]
    assert spark.sql("SELECT length(keystream(1, 20)) n, frame_parse('ACGT', 'v4-balanced') p").first()["n"] == 20
    word = (1 << 64) - 1

    def splitmix(x):
        z = (x + 0x9E3779B97F4A7C15) & word
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & word
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & word
        return z ^ z >> 31

    got = [r[0] % (1 << 64) for r in spark.sql("SELECT splitmix64(id - 3) FROM range(6)").collect()]
    assert got == [splitmix((i - 3) & word) for i in range(6)]


def test_ordered_folds_do_not_depend_on_batches(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2]), rng.randint(0, 60), rng.choice("abcd")) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id bigint, k bigint, s int, v string").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for k in (None, 1, 2):
        own = sorted((s, i, v) for i, kk, s, v in rows if kk == k)
        for n, (s, i, _) in enumerate(own):
            want[i] = len({v for t, _, v in own[: n + 1] if t >= s - 10})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["event_id"]: r["n_distinct"] for r in ordered.distinct_in_window(events, ["k"], "ts", "v", 10, "event_id").collect()}
        assert got == want
        kept = {r["event_id"] for r in ordered.once(events, ["k"], "ts", 15, "event_id").collect()}
        expected = set()
        for k in (None, 1, 2):
            last = None
            for s, i in sorted((s, i) for i, kk, s, _ in rows if kk == k):
                if last is None or s - last >= 15:
                    expected.add(i)
                    last = s
        assert kept == expected
        log = events.select("k", "event_id", "v")
        macs = {(r["k"], r["event_id"]): r["mac"] for r in ordered.chained(log, ["k"], "event_id", "v", b"key").collect()}
        for k in (None, 1, 2):
            mac = ""
            for i, v in sorted((i, v) for i, kk, _, v in rows if kk == k):
                mac = hmac.new(b"key", f"{mac}|{i}|{v}".encode(), hashlib.sha256).hexdigest()
                assert macs[k, i] == mac
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered.once(events.limit(0), ["k"], "ts", 15, "event_id").count() == 0


def test_hmac_of_long_keys(spark):
    for key in (b"k", b"k" * 64, b"k" * 100):
        assert one(spark, archive.hmac_sha256(key, F.lit(b"data"))) == hmac.new(key, b"data", hashlib.sha256).hexdigest()


def test_chunk_table_faults(spark):
    n = 2_000_010
    table = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 3).alias("offset"), F.lit(3).alias("stored"))
    assert tuple(archive.validate_chunks(table).first()) == (n, 0, 0)
    assert tuple(archive.validate_chunks(table.where("idx NOT BETWEEN 999998 AND 1000005")).first()) == (n - 8, 1, 1)
    assert tuple(archive.validate_chunks(table.withColumn("offset", F.col("offset") + F.when(F.col("idx") >= 1_000_000, 1).otherwise(0))).first()) == (n, 0, 1)
    assert tuple(archive.validate_chunks(table.where("idx > 4")).first())[1:] == (1, 1)


def test_bootstrap_draws_sum_to_n(spark):
    w = experiments.bootstrap_weights(spark.range(97).select((F.col("id") * 5).alias("ref")), "ref", 30)
    sums = {r["b"]: r["s"] for r in w.groupBy("b").agg(F.sum("w").alias("s")).collect()}
    assert sums == {b: 97 for b in range(30)}
    counts = [r["w"] for r in w.collect()]
    assert 0.3 < 1 - len(counts) / (97 * 30) < 0.43 and max(counts) >= 4
    assert experiments.bootstrap_weights(spark.range(0).select(F.col("id").alias("ref")), "ref", 3).count() == 0


def test_policy_limits(spark):
    rule = ("allow", "*", "*", "read", ["VERIFIED"], "HIGH")
    many = spark.createDataFrame([(i, *rule) for i in range(1001)], "idx int, effect string, role string, resource string, operation string, integrity array<string>, max_risk string")
    ask = spark.createDataFrame([(1, "a", "read", "x", "LOW", "VERIFIED", "TRUSTED"), (2, "a", "read", "x", "LOW", "VERIFIED", "UNHEARD"), (3, "a", "read", "x", "LOW", "FAILED", "TRUSTED"), (4, "a", "read", "x", "CRITICAL", "VERIFIED", "TRUSTED"), (5, "a", "read", "x", "LOW", "VERIFIED", "ISOLATED")], "event_id int, req_role string, req_operation string, req_resource string, req_risk string, req_integrity string, req_state string")
    with pytest.raises(ValueError):
        security.decide(ask, many)
    assert {r["event_id"] for r in security.decide(ask, many.where("idx < 3")).collect() if r["allowed"]} == {1}


def test_scenarios_are_found_and_everyday_use_is_not(spark):
    def rules(events):
        single = security.single_findings(events).select("event_id", "rule")
        counting = security.counting_findings(events).select("event_id", "rule")
        return single.unionByName(counting).unionByName(security.escalating_findings(events).select("event_id", "rule"))

    attacks = scenarios.attacks(spark).cache()
    found = rules(attacks).join(attacks.select("event_id", "scenario"), "event_id").select("scenario", "rule").distinct().collect()
    hit = {(r["scenario"], r["rule"]) for r in found}
    assert {(n, rule) for n, (rule, _) in scenarios.SCRIPTS.items()} <= hit
    assert rules(scenarios.everyday(spark)).count() == 0


def test_folders_archives_and_packages(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, d in {"b.txt": b"one" * 500, "sub/a.txt": b"two" * 900, "sub/e": b"", "c.txt": b"one" * 500}.items():
        (tmp_path / "in" / n).write_bytes(d)
    rows = folders.files(spark, str(tmp_path / "in")).cache()
    assert [(r["file"], r["path"], r["size"]) for r in rows.orderBy("file").collect()] == [(0, "b.txt", 1500), (1, "c.txt", 1500), (2, "sub/a.txt", 2700), (3, "sub/e", 0)]
    a = archives.build(rows.select("file", "data"), 1000)
    digest = folders.save(a, str(tmp_path / "a"))
    again = folders.load(spark, str(tmp_path / "a"), digest)
    assert again.root == a.root and all(r["ok"] for r in archives.verify(again).collect())
    assert {r["file"]: bytes(r["data"]) for r in archives.extract(again).collect()}[2] == b"two" * 900
    with pytest.raises(ValueError):
        folders.load(spark, str(tmp_path / "a"), "0")
    manifest = tmp_path / "a" / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"refs":', '"refs": '))
    (tmp_path / "a" / ".manifest.json.crc").unlink()
    with pytest.raises(ValueError):
        folders.load(spark, str(tmp_path / "a"))

    clusters = spark.createDataFrame([(1, [1, 2]), (2, [3])], "id bigint, members array<bigint>")
    folders.write_clusters(clusters, str(tmp_path / "k"))
    assert folders.read_clusters(spark, str(tmp_path / "k"), "id bigint, members array<bigint>").count() == 2
    (tmp_path / "k" / "trailer.json").write_text('{"clusters":3,"type":"end"}')
    (tmp_path / "k" / ".trailer.json.crc").unlink()
    with pytest.raises(ValueError):
        folders.read_clusters(spark, str(tmp_path / "k"), "id bigint, members array<bigint>")

    strands = spark.createDataFrame([(1, 0, i, "ACGT" * 10) for i in range(5)], "file bigint, grp bigint, symbol int, seq string")
    facts = packages.write_order(strands, str(tmp_path / "order"), 100)
    assert facts == {"strands": 5} and packages.read_order(spark, str(tmp_path / "order")).count() == 5
    with pytest.raises(ValueError):
        packages.write_order(strands, str(tmp_path / "long"), 30)
    lab = packages.Provider("simulated", 100, lambda s: s.select("seq", F.lit(None).cast("binary").alias("qual")))
    assert lab.fulfil(spark, str(tmp_path / "order"), str(tmp_path / "back")) == {"reads": 5}
    assert packages.read_return(spark, str(tmp_path / "back")).count() == 5
    sheet = next(p for p in (tmp_path / "order" / "sheet").iterdir() if p.name.startswith("part-"))
    sheet.write_text(sheet.read_text() + "x,A,1\n")
    for p in (tmp_path / "order" / "sheet").glob(".*.crc"):
        p.unlink()
    with pytest.raises(ValueError):
        packages.read_order(spark, str(tmp_path / "order"))


def test_studies(spark, tmp_path):
    m = {"name": "s", "version": "1", "seed": 5, "trials": 3, "parameters": {"rate": [0.1, 0.2], "k": [8]}, "deterministic": ["hits"]}
    assert not studies.faults(m) and studies.faults(m | {"trials": 0}) and studies.faults({"name": "x"}) and studies.faults(m | {"more": 1})
    measure = lambda t: t.withColumn("hits", F.col("seed") % 7)
    first, second = studies.run(spark, m, measure), studies.run(spark, m, measure)
    assert first.count() == 6 and first.select("seed").distinct().count() == 6 and studies.reproduced(first, second, m).count() == 0
    changed = second.withColumn("hits", F.when(F.col("trial") == 1, -1).otherwise(F.col("hits")))
    assert {(r["trial"], r["observed"]) for r in studies.reproduced(first, changed, m).collect()} == {(1, "-1")}
    with pytest.raises(ValueError):
        studies.trials(spark, m | {"parameters": {"rate": []}})
    both = first.withColumn("rules", F.when(F.col("trial") == 0, "old").otherwise("new"))
    assert {(r["n_a"], r["n_b"]) for r in studies.compared(both, ["rate"], "rules", "old", "new", "hits").collect()} == {(1, 2)}
    made = []
    make = lambda: made.append(1) or first
    key = {"input": "x", "options": {"b": 1, "a": 2}}
    assert [studies.cached(spark, str(tmp_path), k, make)[1] for k in (key, {"options": {"a": 2, "b": 1}, "input": "x"}, key | {"input": "y"})] == [False, True, False] and len(made) == 2


def test_error_codes(spark):
    assert len(taxonomy.rows()) == len({c for c, *_ in taxonomy.rows()}) == 28 and dict((c, e) for c, _, e, _ in taxonomy.rows())["WRONG_KEY"] == 4
    assert [c for c, _, _, r in taxonomy.rows() if r] == ["NO_SUPERBLOCK", "INSUFFICIENT_REDUNDANCY", "BUDGET_EXCEEDED"]


def test_packed_reads_and_bounds(spark, tmp_path):
    import gzip

    register(spark)
    body = "".join(f">r{i}\n{'ACGT' * (i + 1)}\n" for i in range(20))
    with gzip.open(tmp_path / "r.fa.gz", "wt") as f:
        f.write(body)
    load = lambda **o: spark.read.format("fastx").options(**o).load(str(tmp_path / "r.fa.gz"))
    assert load().count() == 20 and [r["name"] for r in load(maxReads=3).collect()] == ["r0", "r1", "r2"]
    with pytest.raises(Exception, match="letters"):
        load(maxLength=10).count()


def test_command_line(spark, tmp_path, capsys):
    def call(*args):
        code = cli.main(list(args))
        out = json.loads(capsys.readouterr().out)
        assert out["exit_code"] == code and out["schema"] == cli.SCHEMA and out["command"] == args[0]
        return code, out

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(os.urandom(900))
    (tmp_path / "in" / "b.txt").write_bytes(b"text " * 300)
    p = {n: str(tmp_path / n) for n in ("in", "archive", "out", "strands", "reads", "back", "one")}
    assert call("profiles")[1]["result"]["v4-balanced"]["strand_nt"] == 313
    code, out = call("archive", p["in"], p["archive"], "--chunk", "512")
    assert code == 0 and out["result"]["files"] == 2 and call("verify", p["archive"])[1]["result"] == {"index": True, "offsets": True, "merkle": True, "chunks": True}
    assert [e["path"] for e in call("list", p["archive"])[1]["result"]] == ["a.txt", "b.txt"]
    assert call("extract", p["archive"], p["one"], "--path", "b.txt")[0] == 0 and bytes(spark.read.parquet(p["one"]).first()["data"]) == b"text " * 300
    code, out = call("extract", p["archive"], p["one"], "--path", "none")
    assert code == 3 and out["error"]["code"] == "ADDRESS_ERROR"
    assert call("encode", p["in"], p["strands"])[0] == 0 and call("encode", p["in"], p["strands"], "--profile", "none")[0] == 7
    assert call("simulate", p["strands"], p["reads"], "--coverage", "6", "--insertion", "0", "--deletion", "0")[0] == 0
    code, out = call("decode", p["reads"], p["back"])
    assert code == 0 and len(out["result"]["archives"]) == 2
    spark.read.parquet(p["reads"]).limit(0).write.parquet(str(tmp_path / "none"))
    code, out = call("decode", str(tmp_path / "none"), p["back"])
    assert code == 5 and out["error"]["retryable"]
    (tmp_path / "prices.json").write_text('{"vendor": "a", "per_order": 1.5, "per_strand": 0.01, "per_base": 0.001, "max_nt": 400, "min_order": 1}\n')
    assert call("plan", str(tmp_path / "prices.json"), "5000")[1]["result"][0]["fits"] is True
    (tmp_path / "bad.json").write_text('{"vendor": "a"}\n')
    assert call("plan", str(tmp_path / "bad.json"), "5000")[0] == 7
    (tmp_path / "r.fa").write_text(">x\nACGTACGTAA\n>y\nAAAAAAAAAA\n")
    assert call("validate", str(tmp_path / "r.fa"))[1]["result"]["n_strands"] == 2
    assert call("verify", str(tmp_path / "nowhere"))[0] == 70 and np.array(call("errors")[1]["result"]["WRONG_KEY"]["exit_code"]) == 4


def test_screens_by_kernel_and_by_expressions_agree(spark):
    from strandlake.operators import screening

    rng = random.Random(9)
    seqs = ["".join(rng.choice(rng.choice(["ACGT", "AC", "ACGTN", "GATC"])) for _ in range(rng.choice([0, 1, 2, 3, 30, 31, 60]))) for _ in range(400)] + ["ACGé", "AXA", None, "GAATTC" * 4]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for rules in (screening.Rules(), screening.Rules(gc=None, homopolymer=None), screening.Rules(window=(20, 30, 70), tandem=6, motifs=("GAATTC", "ACCA"), length=(2, 40)), screening.Rules(homopolymer=0, tandem=3)):
        found = rules.columns(F.col("seq"))
        want = sum((F.when(found[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(screening.ORDER) if n in found), F.lit(0))
        rows = screening.screen(df, rules).withColumn("want", want).collect()
        assert [(r["seq"], r["violations"]) for r in rows if r["seq"] is not None] == [(r["seq"], r["want"]) for r in rows if r["seq"] is not None]
        assert [r["violations"] for r in rows if r["seq"] is None] == [None]
