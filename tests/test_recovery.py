"""Alignment, stripes, pools that describe themselves, channel models, conformance."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import conformance
from strandlake.kernels import alignment, channel, frames, models, reed_solomon, superblock
from strandlake.operators import stripes, tally
from strandlake.plans import codec, repair


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def replayed(a, b, runs):
    i = j = edits = 0
    for op in alignment.spread(runs):
        assert op != "=" or a[i] == b[j]
        assert op != "X" or a[i] != b[j]
        edits += op != "="
        i, j = i + (op != "I"), j + (op != "D")
    assert (i, j) == (len(a), len(b))
    return edits


def test_alignments_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 14))) for _ in range(2))
        d, runs = alignment.align(a, b)
        assert d == distance(a, b) == replayed(a, b, runs)
        left, right = alignment.leftmost(a, b, runs), alignment.rightmost(a, b, runs)
        assert replayed(a, b, left) == replayed(a, b, right) == d and alignment.leftmost(a, b, left) == left
        banded = alignment.align(a, b, 3)
        assert (banded is None or banded[0] >= d) and (d > 3 or banded[0] == d)
    assert alignment.leftmost("CAAAAG", "CAAAG", [("=", 4), ("D", 1), ("=", 1)]) == [("=", 1), ("D", 1), ("=", 4)]
    assert alignment.rightmost("CAAAAG", "CAAAG", [("=", 1), ("D", 1), ("=", 4)]) == [("=", 4), ("D", 1), ("=", 1)]


def test_events_and_blocks(spark):
    rows = [(1, "ACGTACGT", "ACGAACGT"), (2, "ACGTTACGT", "ACGACGT"), (3, "ACGT", "ACGTGG"), (4, "A" * 90, "C"), (5, None, "A")]
    found = tally.aligned(spark.createDataFrame(rows, "id bigint, ref string, read string"), ["id"], "ref", "read", band=8)
    by = {r["id"]: r for r in found.collect()}
    assert [by[i]["distance"] for i in (1, 2, 3, 4, 5)] == [1, 2, 2, None, 1] and by[2]["cigar"] == "3=2D4="
    blocks = {(r["id"], r["block"], r["idx"], r["cnt"]) for r in tally.blocks(found, ["id"]).collect()}
    assert blocks == {(1, "substitution", "T>A", 1), (2, "deletion", "2", 1), (3, "insertion", "2", 1), (5, "insertion", "1", 1)}


def test_stripe_geometry():
    g = stripes.Geometry(3, 1, 2, 1, 4)
    known = np.ones((1, 3, 4), bool)
    known[0, 0, :2] = False
    assert stripes.structural(known, 3, 2)[0, :2, :3].all()
    known[0, 1, :2] = False
    assert not stripes.structural(known, 3, 2)[0, :2, :3].all()
    for interleaved in (False, True):
        best = stripes.burst_tolerance(g, interleaved)
        assert 1 <= best < 12
    assert stripes.burst_tolerance(stripes.Geometry(4, 2, 3, 0, 4), True) == 6  # two of each of three rows


def test_stripes_lose_nothing_within_the_bound(spark):
    g = stripes.Geometry(5, 2, 3, 1, 8)
    data = {i: bytes(np.random.default_rng(i).integers(0, 256, n).astype(np.uint8)) for i, n in enumerate([0, 1, 8, 40, 41, 119, 120, 121, 700])}
    files = spark.createDataFrame([(i, bytearray(d)) for i, d in data.items()], "file bigint, data binary")
    sizes = files.select("file", F.octet_length("data").cast("bigint").alias("size"))
    sent = stripes.encode(stripes.cut_into_symbols(files, "file", F.col("data"), g), g)
    for lost in ("symbol IN (1, 4)", "line = 0", "line = 2 OR symbol = 3", "line = 3"):
        found = stripes.recover(sent.where(f"NOT ({lost})"), sizes, g).collect()
        got = {i: b"" for i in data}
        for r in sorted(found, key=lambda r: (r["file"], r["stripe"], r["line"], r["symbol"])):
            got[r["file"]] += bytes(r["payload"])
        assert {i: got[i][: len(d)] for i, d in data.items()} == data, lost


def test_pool_tells_archives_apart(spark):
    files = [(i, bytes([i]) * (i * 37)) for i in (1, 2, 3)] + [(65_536 + 3, b"another archive with the same tag" * 9), (9, b"")]
    strands = codec.encode(spark.createDataFrame([(i, bytearray(d)) for i, d in files], "id bigint, data binary"), "id", F.col("data"), described=True).cache()
    exact = strands.select("seq", F.lit(None).cast("binary").alias("qual"))
    pieces, verdicts = codec.decode_pool(exact)
    by = {r["tag"]: r for r in verdicts.collect()}
    assert {t: r["verified"] for t, r in by.items()} == {1: True, 2: True, 3: False, 9: True}
    assert by[3]["fault"] in ("ambiguous tag", "too few symbols") and by[1]["archive"] == codec.archive_id(1).hex()
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["tag"], r["grp"], r["symbol"])):
        got[r["tag"]] = got.get(r["tag"], b"") + bytes(r["data"])
    assert got == {1: files[0][1], 2: files[1][1]}
    few = strands.where("NOT (file = 1 AND grp = -1 AND symbol < 10)").where("NOT (file = 2 AND grp >= 0 AND symbol >= 1)")
    by = {r["tag"]: r for r in codec.decode_pool(few.select("seq", F.lit(None).cast("binary").alias("qual")))[1].collect()}
    assert by[1]["fault"] == "too few symbols" and by[2]["fault"] is None and not by[2]["verified"]
    nothing = codec.decode_pool(exact.limit(0))
    assert nothing[0].count() == nothing[1].count() == 0


def test_channel_parts_beyond_flat_rates():
    strands = np.random.default_rng(0).integers(0, 4, (40, 120)).astype(np.uint8)
    base = {"seed": 3, "coverage": 30, "model": "fixed", "insertion": 0.0, "deletion": 0.0, "substitution": 0.0}
    run = lambda **more: channel.simulate(strands, channel.Channel(**(base | more)), 0)
    assert all((c == strands[s]).all() for c, s in zip(run().codes, run().source, strict=True))
    r = run(substitution=0.2, matrix=((0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 1, 0)))
    assert {(int(a), int(b)) for c, s in zip(r.codes, r.source, strict=True) for a, b in zip(strands[s], c, strict=True) if a != b} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    r = run(substitution=0.1, profile=(0.0, 0.0, 3.0))
    wrong = np.mean([c != strands[s] for c, s in zip(r.codes, r.source, strict=True)], axis=0)
    assert wrong[:50].max() == 0 and wrong[100:].mean() > 0.15
    lengths = np.array([len(c) for c in run(deletion=0.01, deletion_runs=channel.Runs("empirical", weights=(0, 0, 1))).codes])
    assert lengths.min() < 120 and (120 - lengths[lengths >= 114]).max() <= 6 and set((120 - lengths[lengths > 117]).tolist()) <= {0, 1, 2}
    assert max(len(c) for c in run(insertion=0.02, insertion_runs=channel.Runs("geometric", p=0.3)).codes) > 126
    mean = lambda x: np.mean([(c != strands[s]).mean() for c, s in zip(x.codes, x.source, strict=True)])
    assert abs(mean(run(substitution=0.05, spread=2.0)) - 0.05) < 0.01 and abs(mean(run(substitution=0.05, states=((1, 0.0), (1, 2.0)))) - 0.05) < 0.01
    assert mean(run(substitution=1.0)) > 0.99 and abs(mean(run(substitution=1.0, profile=(1.0,))) - channel.SITE_CAP) < 0.01
    runs = np.tile(np.array([0, 0, 0, 0, 1, 2], np.uint8), (5, 20))
    assert channel.run_lengths(runs)[0, :6].tolist() == [4, 4, 4, 4, 1, 1]
    r = channel.simulate(runs, channel.Channel(**(base | {"deletion": 0.05, "homopolymer": (0.0, 1.0, 1.0, 2.0)})), 1)
    assert all((c == 1).sum() == (c == 2).sum() == 20 for c in r.codes) and min((c == 0).sum() for c in r.codes) < 80


def test_model_documents():
    c = channel.Channel(substitution=0.02, states=((1.0, 0.5), (1.0, 1.5)), deletion_runs=channel.Runs("geometric", 0.6))
    doc = models.to_document("own-model", "1.2.0", c)
    assert not models.faults(doc) and models.from_document(doc) == c
    registry = models.Registry()
    for v in ("1.2.0", "1.10.0", "2.0.0-rc1", "1.9.9"):
        registry.add(models.digest_text(models.to_document("own-model", v, c)))
    assert registry.resolve("own-model")["version"] == "2.0.0-rc1" and registry.resolve("own-model@1.9.9")["version"] == "1.9.9"
    with pytest.raises(KeyError):
        registry.resolve("own-model@3")
    with pytest.raises(ValueError):
        registry.add(models.digest_text(doc))
    assert models.overridden(doc, {"sequencing.deletion": 0.5})["stages"]["sequencing"]["deletion"] == 0.5 and doc["stages"]["sequencing"]["deletion"] == 0.002
    for path, bad in (("sequencing.deletion", 2), ("sequencing.matrix", [[1]]), ("amplification.coverage", "x")):
        with pytest.raises(ValueError):
            models.from_document(models.overridden(doc, {path: bad}))
    with pytest.raises(ValueError):
        registry.add('{"schema": 1, "schema": 2}')


def test_conformance_vectors(spark):
    layout = frames.PROFILES["v4-balanced"][0]
    word = np.arange(60, dtype=np.uint8)
    word = np.concatenate([word, reed_solomon.parity(word[None], 8)[0]])
    bad = word.copy()
    bad[[3, 9, 50]] ^= 7
    block = superblock.Superblock("cauchy-rs", 64, 16, layout, b"a" * 16, 9_000, b"s" * 32).pack()
    vectors = [
        # fixed outputs of the published format
        {"id": "keystream.v000", "operation": "scrambler.keystream", "params": {"variant": 0, "span": 53, "bytes": 16}, "expected": {"outputs": {"keystream_hex": "3df15fd5b6b1b27a365a7c25a75df233"}}},
        {"id": "keystream.v001", "operation": "scrambler.keystream", "params": {"variant": 1, "span": 53, "bytes": 16}, "expected": {"outputs": {"keystream_hex": "8233fba276a221e6a5f7a2f1a361d338"}}},
        {"id": "bases", "operation": "mapping.bytes_to_nt", "params": {"bytes_hex": "00112233445566778899aabbccddeeff"}, "expected": {"outputs": {"nt": "AAAAACACAGAGATATCACACCCCCGCGCTCTGAGAGCGCGGGGGTGTTATATCTCTGTGTTTT"}}},
        {"id": "crc", "operation": "crc32", "params": {"rows_hex": b"123456789".hex(), "row_bytes": 9}, "expected": {"outputs": {"crc32": ["cbf43926"]}}},
        {"id": "repair", "operation": "rs.decode", "params": {"parity": 8}, "inputs": {"word": bad.tobytes().hex()}, "expected": {"outputs": {"ok": True, "word_hex": word.tobytes().hex(), "fixed": 3}}},
        {"id": "too few", "operation": "outer.row-decode", "params": {"k": 3, "m": 2}, "inputs": {"0": "00", "4": "01"}, "expected": {"error": {"code": "INSUFFICIENT_REDUNDANCY"}}},
        {"id": "description", "operation": "superblock.unpack", "inputs": {"superblock": block.hex()}, "expected": {"outputs": {"k": 64, "m": 16, "size": 9_000}}},
        {"id": "forged", "operation": "superblock.unpack", "inputs": {"superblock": (block[:8] + b"\0\0" + block[10:]).hex()}, "expected": {"error": {"code": "FORMAT_ERROR"}}},
        {"id": "wrong", "operation": "crc32", "params": {"rows_hex": "00", "row_bytes": 1}, "expected": {"outputs": {"crc32": ["00000000"]}}},
        {"id": "not refused", "operation": "crc32", "params": {"rows_hex": "00", "row_bytes": 1}, "expected": {"error": {}}},
        {"id": "new", "operation": "no.such", "expected": {"outputs": {}}},
    ]
    out = {r["id"]: r["outcome"] for r in conformance.run(spark, map(json.dumps, vectors)).collect()}
    assert {i for i, o in out.items() if o == "agrees"} == {"keystream.v000", "keystream.v001", "bases", "crc", "repair", "too few", "description", "forged"}
    assert out["wrong"] == "differs in crc32" and out["not refused"] == "accepted" and out["new"] == "unknown operation"
    payload = bytes(range(40))
    built = conformance.check({"id": "b", "operation": "frame4.build", "params": {"profile": "v4-balanced", "tag": 4660, "kind": 0, "group": 7, "symbol": 3}, "inputs": {"payload": payload.hex()}, "expected": {"outputs": {"variant": 0}}})
    strands, variant = frames.build(layout, frames.Screen(), 4660, 0, [7], [3], np.frombuffer(payload, np.uint8)[None])
    assert (built == "agrees") == (variant[0] == 0) and len(hashlib.sha256(strands.tobytes()).digest()) == 32


def test_soft_decisions_find_what_hard_ones_miss():
    layout, _, _ = frames.PROFILES["v4-balanced"]
    rng = np.random.default_rng(5)
    payloads = rng.integers(0, 256, (60, 40)).astype(np.uint8)
    strands, _ = frames.build(layout, frames.Screen(), 1, 0, range(60), range(60), payloads)
    noisy, quality = strands.copy(), np.full(strands.shape, 30, np.uint8)
    for i in range(60):
        for at in rng.choice(layout.frame_bytes, 12, replace=False):  # beyond half the parity, within it as erasures
            place = layout.frame_at[4 * at + 1]
            noisy[i, place] = (noisy[i, place] + 1) % 4
            quality[i, place] = 5
    f, e, _ = frames.strip(layout, noisy)
    assert not frames.parse(layout, f, e).ok.any()
    p = frames.softly(layout, noisy, quality)
    assert p.ok.all() and (p.payload == payloads).all() and (p.group == np.arange(60)).all()


def test_markers_tell_the_way_round():
    layout, _, _ = frames.PROFILES["v4-balanced"]
    strands, _ = frames.build(layout, frames.Screen(), 1, 0, range(50), range(50), np.random.default_rng(6).integers(0, 256, (50, 40)).astype(np.uint8))
    complement = np.array([3, 2, 1, 0, 4], np.uint8)
    reads = [np.delete(s, 100) if i % 2 else complement[np.insert(s, 50, 2)[::-1]] for i, s in enumerate(strands)]
    assert (frames.lean(layout, reads) >= codec.DECIDED).tolist() == [i % 2 == 1 for i in range(50)] and (np.abs(frames.lean(layout, reads)) >= codec.DECIDED).all()


def test_votes_mend_indels():
    rng = random.Random(2)
    for _ in range(20):
        truth = "".join(rng.choice("ACGT") for _ in range(120))
        reads = []
        for _ in range(9):
            s = list(truth)
            for _ in range(4):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], [rng.choice("ACGT")], [s[at], rng.choice("ACGT")]])
            reads.append("".join(s))
        centre = reads[repair.medoid(reads)]
        for _ in range(repair.ROUNDS):
            centre = repair.voted(centre, reads)
        assert distance(centre, truth) <= 1


def test_rounds_fill_what_the_scan_leaves(spark):
    layout, _, _ = frames.PROFILES["v4-balanced"]
    rng = np.random.default_rng(7)
    strands, _ = frames.build(layout, frames.Screen(), 5, 0, [0] * 12, range(12), rng.integers(0, 256, (12, 40)).astype(np.uint8))
    rows, turned = [], str.maketrans("ACGT", "TGCA")
    for i in range(4):  # clean
        rows.append((frames.sequence(strands[i]), b"?" * 313))
    for i in range(4, 8):  # many marked substitutions
        c, q = strands[i].copy(), np.full(313, 30, np.uint8)
        for at in rng.choice(layout.frame_bytes, 12, replace=False):
            place = layout.frame_at[4 * at]
            c[place], q[place] = (c[place] + 2) % 4, 3
        rows.append((frames.sequence(c), q.tobytes()))
    for i in range(8, 12):  # many indels, but several reads, both ways round
        for k in range(9):
            s = list(frames.sequence(strands[i]))
            for at in sorted(rng.choice(313, 9, replace=False).tolist(), reverse=True):
                s[at : at + 1] = [] if rng.random() < 0.5 else [s[at], "ACGT"[int(rng.integers(0, 4))]]
            text = "".join(s)
            rows.append((text.translate(turned)[::-1] if k % 3 == 0 else text, None))
    reads = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(rows)], "read bigint, seq string, qual binary")
    scanned = codec.scan(reads.withColumn("file", F.lit(0).cast("bigint")))
    found, log = repair.rounds(reads, scanned)
    got = {(r["symbol"], r["round"]) for r in found.where("tag = 5").collect()}
    assert {(i, "scan") for i in range(4)} | {(i, "soft") for i in range(4, 8)} <= got and len({s for s, _ in got}) >= 11
    assert [r["round"] for r in log.collect()] == ["scan", "soft", "cluster"] and found.count() == len({s for s, _ in got})


def test_stages_follow_each_other():
    strands = np.random.default_rng(0).integers(0, 4, (30, 80)).astype(np.uint8)
    quiet = channel.Channel(substitution=0, insertion=0, deletion=0, model="fixed", coverage=2)
    r = channel.staged(strands, [quiet, quiet, quiet], 1, (0,))
    assert len(r.codes) == 240 and all((c == strands[s]).all() for c, s in zip(r.codes, r.source, strict=True)) and r.counts["2.reads"] == 240
    loud = channel.Channel(deletion=0.05, insertion=0.0, substitution=0.0, model="fixed", coverage=1)
    a, b = (channel.staged(strands, [loud, channel.Channel(model="poisson", coverage=3, reverse=0.5, substitution=0, insertion=0, deletion=0)], 2, (1,)) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a.codes, b.codes, strict=True)) and a.reversed.any() and len({len(c) for c in a.codes}) > 2
