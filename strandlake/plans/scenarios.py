"""Ten scripted attacks and everyday use as security events, to try detectors on (O11 rows). Synthetic, in memory only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT = "event_id bigint, ts timestamp, session string, principal string, resource string, operation string, kind string, result string, code string, scenario string"

#: scenario -> (rule that has to find it, one event after another: times, seconds between, kind, operation, resource, result, code).
SCRIPTS: dict[str, tuple[str, list[tuple[int, float, str, str, str, str, str]]]] = {
    "guessed passwords": ("auth_failures", [(6, 2.0, "auth", "login", "login", "deny", "bad_secret")]),
    "closed archive": ("authz_failures", [(6, 2.0, "request", "read", "archive:a", "deny", "policy")]),
    "beyond the token": ("privilege_escalation", [(1, 1.0, "request", "admin", "system", "deny", "capability")]),
    "malformed input": ("malformed_input", [(3, 2.0, "request", "read", "archive:b", "error", "malformed")]),
    "replayed request": ("replay", [(1, 1.0, "request", "list", "archive:a", "allow", ""), (1, 0.5, "request", "list", "archive:a", "deny", "replay")]),
    "stolen token": ("token_misuse", [(1, 1.0, "request", "read", "archive:a", "deny", "session_mismatch")]),
    "changed program": ("integrity_monitor", [(1, 1.0, "integrity", "check", "component:x", "deny", "")]),
    "flood": ("request_rate", [(140, 0.2, "request", "list", "archive:a", "allow", "")]),
    "changed archive": ("tamper", [(3, 2.0, "request", "read", "archive:c", "error", "integrity")]),
    "bait": ("deception", [(1, 1.0, "request", "read", "deception:keys", "allow", "")]),
}
START = 1_700_000_000.0


def attacks(spark: SparkSession, seed: int = 0) -> DataFrame:
    """The events of all scenarios, each in its own session and hour."""
    rows = []
    for i, (name, (_, steps)) in enumerate(SCRIPTS.items()):
        at = START + 3600.0 * (i + seed)
        for times, gap, kind, operation, resource, result, code in steps:
            for _ in range(times):
                rows.append((len(rows), at, f"s{i}", f"p{i}", resource, operation, kind, result, code, name))
                at += gap
    return _events(spark, rows)


def everyday(spark: SparkSession, minutes: int = 30) -> DataFrame:
    """Three users at their work, with one wrong password: nothing of it is a finding."""
    rows: list[tuple] = [(0, START, "s-b2", "bob", "login", "login", "auth", "deny", "bad_secret", "")]
    for minute in range(minutes):
        for u, user in enumerate(("alice", "bob", "ops")):
            for k, operation in enumerate(("list", "verify", "read", "locate") if user != "ops" else ("admin",)):
                at = START + 60.0 * minute + 20 * u + 5 * k
                rows.append((len(rows), at, f"s-{user}", user, f"archive:{'ab'[k % 2]}", operation, "request", "allow", "", ""))
    return _events(spark, rows)


def _events(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    plain = spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts double"))
    return plain.withColumn("ts", plain["ts"].cast("timestamp"))
