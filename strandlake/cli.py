"""The command line: ``python -m strandlake COMMAND``. Each command is one call of the library and prints one JSON envelope.

The envelope: schema, command, status, exit_code, result or error (code, category, retryable, message), provenance. The
exit code is that of the error's category; commands read and write what Spark can reach.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable

from . import __doc__ as about
from .functions.text import canonical
from .operators import taxonomy

SCHEMA = "strandlake.result/1"


class Failure(Exception):
    """A typed failure: one of the stable codes and a message."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _session():
    from .session import builder, prepare
    from .sources import register

    spark = builder("strandlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    register(spark)
    return spark


def _files(spark, folder: str):
    from .sources.folders import files

    rows = files(spark, folder)
    if bad := rows.where("fault IS NOT NULL OR data IS NULL").limit(1).collect():
        raise Failure("FORMAT_ERROR", f"{bad[0]['path']}: {bad[0]['fault'] or 'changed while it was read'}")
    return rows


def profiles(_) -> dict:
    from .kernels.frames import PROFILES

    return {n: {"payload": lay.payload, "parity": lay.parity, "strand_nt": lay.strand_nt, "k": k, "m": m} for n, (lay, k, m) in PROFILES.items()}


def errors(_) -> dict:
    return {code: {"category": category, "exit_code": exit_code, "retryable": retryable} for code, category, exit_code, retryable in taxonomy.rows()}


def archive(args) -> dict:
    from .plans import archives
    from .sources import folders

    spark = _session()
    rows = _files(spark, args.folder)
    built = archives.build(rows.select("file", "data"), args.chunk)
    digest = folders.save(built, args.out)
    rows.select("file", "path", "size").write.mode("overwrite").parquet(f"{args.out}/names")
    return {"root": built.root, "manifest": digest, "files": rows.count(), "chunks": built.chunks.count()}


def _archive(spark, folder: str):
    from .sources import folders

    try:
        return folders.load(spark, folder)
    except ValueError as e:
        raise Failure("FORMAT_ERROR", str(e)) from e


def verify(args) -> dict:
    from .plans import archives

    spark = _session()
    found = {r["name"]: r["ok"] for r in archives.verify(_archive(spark, args.folder)).collect()}
    if not all(found.values()):
        raise Failure("INTEGRITY_ERROR", ", ".join(sorted(n for n, ok in found.items() if not ok)))
    return found


def entries(args) -> list:
    spark = _session()
    _archive(spark, args.folder)
    return [r.asDict() for r in spark.read.parquet(f"{args.folder}/names").orderBy("path").toLocalIterator()]


def extract(args) -> dict:
    from .plans import archives

    spark = _session()
    names = spark.read.parquet(f"{args.folder}/names")
    wanted = names.where(names["path"] == args.path) if args.path else names
    if wanted.isEmpty():
        raise Failure("ADDRESS_ERROR", f"{args.path} is not in the archive")
    out = archives.extract(_archive(spark, args.folder), wanted=wanted).join(names, "file")
    out.select("path", "data").write.mode("overwrite").parquet(args.out)
    n, expected = spark.read.parquet(args.out).count(), wanted.count()
    if n < expected:
        raise Failure("INTEGRITY_ERROR", f"{expected - n} files did not verify and were not published")
    return {"files": n}


def encode(args) -> dict:
    from .plans import codec
    from .sources import folders

    spark = _session()
    rows = _files(spark, args.folder)
    if rows.count() > 65_536:
        raise Failure("ARCHIVE_TAG_COLLISION", "a pool has 65,536 archives at most")
    try:
        strands = codec.encode(rows.select("file", "data"), "file", rows["data"], args.profile, described=True)
        strands.write.mode("overwrite").parquet(args.out)
    except KeyError as e:
        raise Failure("CONFIGURATION_ERROR", f"no profile {e}") from e
    n = spark.read.parquet(args.out).count()
    folders._write_text(spark, f"{args.out}.json", canonical({"profile": args.profile, "strands": n}))
    return {"strands": n}


def simulate(args) -> dict:
    from .kernels.channel import Channel
    from .plans import codec

    spark = _session()
    model = Channel(seed=args.seed, coverage=args.coverage, substitution=args.substitution, insertion=args.insertion, deletion=args.deletion)
    codec.read(spark.read.parquet(args.strands), model, args.profile).select("seq", "qual").write.mode("overwrite").parquet(args.out)
    return {"reads": spark.read.parquet(args.out).count(), "simulated": True}


def decode(args) -> dict:
    from .plans import codec

    spark = _session()
    pieces, verdicts = codec.decode_pool(spark.read.parquet(args.reads), args.profile)
    rows = verdicts.collect()  # 65,536 at most
    if not rows:
        raise Failure("NO_SUPERBLOCK", "no archive describes itself in these reads")
    pieces.write.mode("overwrite").parquet(args.out)
    good = [r["archive"] for r in rows if r["verified"]]
    if len(good) < len(rows):
        raise Failure("INSUFFICIENT_REDUNDANCY", f"{len(rows) - len(good)} of {len(rows)} archives could not be verified; the others were published")
    return {"archives": sorted(good)}


def validate(args) -> dict:
    from pyspark.sql import functions as F

    from .operators import screening

    spark = _session()
    reads = spark.read.format("fastx").load(args.reads)
    return screening.summary(screening.screen(reads, screening.Rules()).withColumn("all", F.lit("all")), ["all"]).drop("all").first().asDict()


def plan(args) -> list:
    from pyspark.sql import functions as F

    from .operators import planning
    from .sources import folders

    spark = _session()
    try:
        prices = folders.price_list(spark, args.prices)
    except ValueError as e:
        raise Failure("CONFIGURATION_ERROR", str(e)) from e
    plans = spark.range(1).select(planning.strands(F.lit(args.size), 64, 16, 40).alias("n_strands"), F.lit(313).alias("nt"))
    return [r.asDict() for r in planning.cost(plans, prices).select("vendor", "n_strands", "fits", "cost").orderBy("vendor").collect()]


COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {
    "profiles": (profiles, []),
    "errors": (errors, []),
    "archive": (archive, [("folder", {}), ("out", {}), ("--chunk", {"type": int, "default": 65_536})]),
    "verify": (verify, [("folder", {})]),
    "list": (entries, [("folder", {})]),
    "extract": (extract, [("folder", {}), ("out", {}), ("--path", {"default": None})]),
    "encode": (encode, [("folder", {}), ("out", {}), ("--profile", {"default": "v4-balanced"})]),
    "simulate": (simulate, [("strands", {}), ("out", {}), ("--profile", {"default": "v4-balanced"}), ("--seed", {"type": int, "default": 0}), ("--coverage", {"type": float, "default": 5.0}), ("--substitution", {"type": float, "default": 0.01}), ("--insertion", {"type": float, "default": 0.002}), ("--deletion", {"type": float, "default": 0.002})]),
    "decode": (decode, [("reads", {}), ("out", {}), ("--profile", {"default": "v4-balanced"})]),
    "validate": (validate, [("reads", {})]),
    "plan": (plan, [("prices", {}), ("size", {"type": int})]),
}


def envelope(command: str, run: Callable[[], object]) -> dict:
    """The envelope of one call; no exception leaves it."""
    started = time.time()
    out: dict = {"schema": SCHEMA, "command": command}
    try:
        out |= {"status": "SUCCESS", "exit_code": 0, "result": run()}
    except Exception as e:  # noqa: BLE001  the envelope tells what happened
        code = e.code if isinstance(e, Failure) else "INTERNAL_ERROR"
        category, exit_code, retryable = next((b, c, d) for a, b, c, d in taxonomy.rows() if a == code)
        out |= {"status": "FAILED", "exit_code": exit_code, "error": {"code": code, "category": category, "retryable": retryable, "message": str(e)[:2000]}}
    return out | {"provenance": {"engine": "strandlake", "seconds": round(time.time() - started, 3)}}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("strandlake", description=about)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
    args = parser.parse_args(argv)
    out = envelope(args.command, lambda: COMMANDS[args.command][0](args))
    print(json.dumps(out, default=str, sort_keys=True))
    return out["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
