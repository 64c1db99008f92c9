"""Operators on small hand-made tables."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import archive, clustering, consensus, erasure, experiments, journal, screening, security
from strandlake.operators.common import numbered
from strandlake.plans import codec


def column(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()["x"]


def test_sequences(spark):
    assert column(spark, b"\x00\x1b\xff", S.from_bytes, "binary") == "AAAAACGTTTTT"
    assert column(spark, "AAAAACGTTTTT", S.to_bytes) == b"\x00\x1b\xff"
    assert column(spark, "ACGNN", S.to_bytes) is None
    assert column(spark, "AACGN", S.reverse_complement) == "NCGTT"
    assert column(spark, "AAACCGGGGT", S.longest_run) == 4
    assert column(spark, "", S.longest_run) == 0


@pytest.mark.parametrize(("seq", "hit"), [("ACACACAC", True), ("ACACACA", False), ("ACGTACGT", False)])
def test_tandem(spark, seq, hit):
    assert column(spark, seq, lambda c: S.tandem_over(c, 2, 7)) is hit


def test_tandem_against_scan(spark):
    import random
    random.seed(4)
    seqs = ["".join(random.choice("AC") for _ in range(14)) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for p in (2, 3):
        got = [r["x"] for r in df.select(S.tandem_over(F.col("s"), p, 7).alias("x")).collect()]
        n = 7 - p + 1
        want = [any(all(s[i + j] == s[i + j + p] for j in range(n)) for i in range(len(s) - p - n + 1)) for s in seqs]
        assert got == want


def test_screen_bits(spark):
    df = spark.createDataFrame([("ACGT" * 5,), ("A" * 20,), ("ACGTGAATTCACGTACGTAC",), ("ACGX",)], "seq string")
    rules = screening.Rules(motifs=("GAATTC",), length=(5, 30))
    bits = [r["violations"] for r in screening.screen(df, rules).collect()]
    assert bits[0] == 0 and bits[1] & 1 and bits[1] & 4 and bits[2] & 16 and bits[3] & 32 and bits[3] & 64


def test_majority_drops_ties(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c")]
    out = consensus.majority(spark.createDataFrame(rows, "k int, p string"), ["k"], "p")
    assert sorted((r["k"], r["p"], r["n"], r["n_kinds"]) for r in out.collect()) == [(1, "a", 2, 2), (3, "c", 1, 1)]


def test_snap_against_brute_force(spark):
    import random
    random.seed(5)
    keys = [f"{random.getrandbits(16):04X}" for _ in range(400)]
    lack, pend = sorted(set(keys[:150])), [(i, a, b) for i, (a, b) in enumerate(zip(keys[150:270], keys[270:390], strict=True))]
    out = consensus.snap(spark.createDataFrame(pend, "id int, key string, alt string"), spark.createDataFrame([(k,) for k in lack], "key string"), 2, other="alt")
    got = {r["id"]: r["snapped"] for r in out.collect()}

    def brute(a, b):
        if a in lack:
            return a
        if b in lack:
            return b
        split = lambda x: (x[:2], x[2:])
        near = [m for m in lack if sum(x not in (y, z) for x, y, z in zip(split(m), split(a), split(b), strict=True)) <= 1 and any(sum(x != y for x, y in zip(split(m), split(r), strict=True)) <= 1 for r in (a, b))]
        return near[0] if len(near) == 1 else None
    assert got == {i: brute(a, b) for i, a, b in pend}


def test_groups_decode_or_fail_closed(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [(g, n, rng.integers(0, 256, 8).astype(np.uint8).tobytes()) for g in range(3) for n in range(5)]
    data = spark.createDataFrame([(g, n, bytearray(p)) for g, n, p in rows], "g bigint, n int, p binary")
    both = data.unionByName(erasure.encode_groups(data, ["g"], "n", "p", 5, 2))
    left = both.where("NOT (n IN (0, 3) AND g = 0) AND NOT (n IN (0, 1, 2) AND g = 1)").withColumn("used", F.lit(5))
    out = {(r["g"], r["n"]): bytes(r["p"]) for r in erasure.decode_groups(left, ["g"], "n", "p", 5, 2, "used").collect()}
    assert out == {(g, n): p for g, n, p in rows if g != 1}


def test_hmac_and_merkle(spark):
    assert column(spark, b"data", lambda c: archive.hmac_sha256(b"key", c), "binary") == hmac.new(b"key", b"data", "sha256").hexdigest()
    h = lambda *x: hashlib.sha256(b"".join(x)).digest()
    leaves = [h(b"\0", bytes([i])) for i in range(5)]
    a, b = h(b"\1", leaves[0], leaves[1]), h(b"\1", leaves[2], leaves[3])
    root = h(b"\1", h(b"\1", a, b), leaves[4]).hex()
    levels = archive.merkle_levels(spark.createDataFrame([(i, x.hex()) for i, x in enumerate(leaves)], "pos bigint, hash string"))
    assert archive.merkle_root(levels).first()["root"] == root
    proofs = archive.merkle_proofs(levels, levels.where("level = 0").select("pos")).join(levels.where("level = 0").select("pos", "hash"), "pos")
    assert {r["x"] for r in proofs.select(archive.proof_root(F.col("hash"), F.col("proof")).alias("x")).collect()} == {root}
    empty = archive.merkle_levels(spark.createDataFrame([], "pos bigint, hash string"))
    assert archive.merkle_root(empty).first()["root"] == hashlib.sha256(b"").hexdigest()


def test_numbered_and_components(spark):
    out = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"])
    assert out.where("k != idx").count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)] + [(i, i + 1) for i in range(100, 160)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in clustering.components(edges).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4)) and got[11] == 10 and all(got[i] == 100 for i in range(100, 161))
    turned = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 0)], "a bigint, b bigint, rel int")
    assert {r["node"]: (r["root"], r["flipped"]) for r in clustering.oriented_components(turned).collect()} == {1: (1, False), 2: (1, True), 3: (1, False), 4: (1, False)}


def test_publish_and_validate(spark):
    refs = spark.createDataFrame([("x", 0), ("x", 1), ("y", 1), ("z", 2)], "file string, idx int")
    ok = spark.createDataFrame([(0, True), (1, True), (2, False)], "idx int, verified boolean")
    assert sorted(r["file"] for r in archive.publishable(refs, ok, "file").collect()) == ["x", "y"]
    table = spark.createDataFrame([(0, 0, 5), (1, 5, 5), (3, 11, 5)], "idx int, offset int, stored int")
    assert archive.validate_chunks(table).first().asDict() == {"n_chunks": 3, "n_gaps": 1, "n_breaks": 1}


def test_outcomes(spark):
    rows = [(True, False, "SUCCESS", 0, 1), (False, True, "SUCCESS", 0, 1), (False, False, "SUCCESS", 0, 1), (False, False, "SUCCESS", 2, 1), (False, False, "PARTIAL", 0, 1), (False, False, "FAILURE", 5, 0), (False, False, "FAILURE", 5, 1), (False, False, None, 0, 0), (False, False, None, 5, 0)]
    df = spark.createDataFrame(rows, "c boolean, w boolean, s string, e int, p int")
    got = [r["x"] for r in df.select(experiments.outcome(*[F.col(c) for c in "cwsep"]).alias("x")).collect()]
    assert got == ["CRASH", "FALSE_SUCCESS", "EXACT", "CRASH", "PARTIAL", "EXPLICIT_FAILURE", "CRASH", "CRASH", "EXPLICIT_FAILURE"]


def test_cache_and_alerts(spark):
    rows = [(i, f"2024-01-01 00:0{i}:00", 10) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, at string, size int").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r["id"] for r in journal.cached(df, "size", "at", "id", 25).collect()) == [4, 5]
    m = spark.createDataFrame([("load", 9), ("load", 1)], "name string, value int")
    assert [r["alert"] for r in experiments.alerts(m, {"high": "value > 5"}).collect()] == ["high"]


def test_once_per_window(spark):
    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:04:00", 2), (1, "2024-01-01 00:05:00", 3), (2, "2024-01-01 00:00:00", 4)]
    df = spark.createDataFrame(rows, "k int, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["event_id"] for r in security.once_per_window(df, ["k"], "ts", 300).collect()) == [1, 3, 4]


def test_files_are_recovered_or_refused(spark):
    from strandlake.kernels.channel import Channel
    files = spark.createDataFrame([(1, bytearray(b"some bytes " * 20)), (2, bytearray(b"")), (3, bytearray(bytes(range(256)) * 12))], "id bigint, data binary")
    held = codec.manifest(files, "id", F.col("data"))
    strands = codec.encode(files, "id", F.col("data"))
    reads = codec.read(strands, Channel(seed=1, coverage=4.0, reverse=0.5, dropout=0.05))
    resolved = codec.resolve(codec.scan(reads))
    out = {r["file"]: (r["verified"], r["data"] and bytes(r["data"])) for r in codec.recover(resolved, held).collect()}
    assert out == {1: (True, b"some bytes " * 20), 2: (True, b""), 3: (True, bytes(range(256)) * 12)}
    few = codec.recover(resolved.where("symbol < 2"), held).where("file = 1").first()
    assert not few["verified"] and few["data"] is None


def test_reads_of_both_orientations_cluster(spark):
    import random
    rng = random.Random(8)
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = []
    for _ in range(4):
        strand = "".join(rng.choice("ACGT") for _ in range(150))
        for c in range(4):
            read = list(strand)
            read[rng.randrange(150)] = "A"
            rows.append((len(rows), turn("".join(read)) if c % 2 else "".join(read)))
    reads = spark.createDataFrame(rows, "id bigint, seq string")
    pairs = clustering.oriented_candidates(clustering.oriented_sketch(reads, "id", F.col("seq")), "id")
    edges = clustering.verified(pairs, reads, "id", "seq")
    found = {r["node"]: (r["root"], r["flipped"]) for r in clustering.oriented_components(edges).collect()}
    assert found == {i: (i // 4 * 4, bool(i % 2)) for i in range(16)}


def test_strands_in_bounded_batches(spark, monkeypatch):
    texts = [(1, "abc" * 41), (2, ""), (3, None), (4, "x" * 700), (5, "ä日 \x00"), (6, "q" * 30)]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    data = F.encode("text", "UTF-8")
    for nt, letters in ((120, 1 << 21), (120, 500), (7, 100)):
        monkeypatch.setattr(screening, "MATRIX", letters)
        cut = screening.strands(df, data, nt, ["id"])
        assert "Generate" not in cut._jdf.queryExecution().executedPlan().toString()
        want = {(r["id"], i, r["seq"][i * nt : (i + 1) * nt]) for r in df.select("id", S.from_bytes(data).alias("seq")).where("seq IS NOT NULL").collect() for i in range(-(-len(r["seq"]) // nt))}
        got = [tuple(r) for r in cut.collect()]
        assert len(got) == len(want) and set(got) == want


def test_snap_meets_no_pairs(spark):
    """Of keys that share a mask only the extremes meet a pending key, however many there are."""
    lack = spark.createDataFrame([(f"00{i:02X}",) for i in range(200)] + [("AA00",), ("AB01",)], "key string")
    pend = spark.createDataFrame([(i, f"00{i:02X}") for i in range(190, 256)] + [(300, "AAFF"), (301, "AB00"), (302, "FFFF"), (303, None)], "id int, key string")
    out = consensus.snap(pend, lack, 2)
    got = {r["id"]: r["snapped"] for r in out.collect()}
    assert got == {i: f"00{i:02X}" if i < 200 else None for i in range(190, 256)} | {300: "AA00", 301: None, 302: None, 303: None}
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(low" in tree and "max(high" in tree
