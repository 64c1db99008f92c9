"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed over a full write to the noop sink, so nothing is collected, after a run on the smallest tables.
``codec`` has the seconds of encoding and decoding.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

HEADLINE = [
    "strand_summary", "dna_encode", "dna_decode", "reverse_complement", "constraint_screen", "violation_summary", "chunk_dedup", "merkle_root", "majority_resolve", "position_vote", "snap_address",
    "candidate_pairs", "gf256_parity", "rate_detector", "risk_score", "policy_decisions", "latest_version", "sweep_curve", "bootstrap_totals", "ks_distance", "cost_plan", "roundtrip_recovery",
]


def codec_rates(spark) -> dict[str, float]:
    """Seconds to encode and to decode generated blocks of 1 and 4 MiB (each block a file of 64 KiB), after a warm-up.

    The read channel is the one of the published figures: substitution 1 %, insertion and deletion 0.2 %, coverage 5.
    Encoding runs from bytes to strands, decoding from reads to verified files.
    """
    from pyspark.sql import functions as F

    from strandlake.kernels.channel import Channel
    from strandlake.plans import codec
    from strandlake.sources import register

    register(spark)
    noise = Channel(seed=1, coverage=5.0, substitution=0.01, insertion=0.002, deletion=0.002)
    out: dict[str, float] = {}

    def once(size: int) -> tuple[float, float, int, int]:
        rows = spark.read.format("generated").option("kind", "mixed").option("blocks", size // 65_536).option("blockBytes", 65_536).option("blocksPerPartition", 2).load()
        blocks = rows.selectExpr("block AS id", "data").cache()
        files = codec.manifest(blocks, "id", F.col("data")).cache()
        files.count()
        started = time.time()
        strands = codec.encode(blocks, "id", F.col("data")).cache()
        n = strands.count()
        encoded = time.time() - started
        reads = codec.read(strands, noise).cache()
        reads.count()
        started = time.time()
        good = codec.recover(codec.resolve(codec.scan(reads)), files).where("verified").count()
        decoded = time.time() - started
        for df in (blocks, files, strands, reads):
            df.unpersist()
        return encoded, decoded, n, good

    once(1 << 18)
    for size in (1, 4):
        encoded, decoded, n, good = once(size << 20)
        out |= {f"encode_{size}MiB_sec": encoded, f"decode_indel_{size}MiB_sec": decoded, f"strands_{size}MiB": n, f"verified_{size}MiB": good}
    return {k: round(v, 3) for k, v in out.items()}


def main() -> None:
    from strandlake.plans import catalog
    from strandlake.session import builder, prepare

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = builder("bench", cpus).config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in HEADLINE:  # compiles code and starts the Python workers
        catalog.QUERIES[name](spark, small if os.path.isdir(small) else sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    codec = codec_rates(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "codec": codec, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
