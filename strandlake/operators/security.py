"""Event detection, risk and policy (W7-W8, ST8-ST12, A22, F11, J16 rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import points, risk_level
from .ordered import distinct_in_window, once


def _trailing(key: list[str], ts: str, seconds: int):
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return Window.partitionBy(*key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)


def counted(events: DataFrame, key: list[str], ts: str, seconds: int, name: str = "n_window") -> DataFrame:
    """Adds the number of the key's events in the trailing window (both ends included)."""
    return events.withColumn(name, F.count("*").over(_trailing(key, ts, seconds)))


def bursts(events: DataFrame, key: list[str], ts: str, seconds: int, least: int) -> DataFrame:
    """Events at which the trailing window holds at least ``least``."""
    return counted(events, key, ts, seconds).where(F.col("n_window") >= least)


def enumerations(events: DataFrame, key: list[str], ts: str, resource: str, seconds: int, over: int, tie: str = "event_id") -> DataFrame:
    """key, tie, n_distinct of events at which the trailing window holds more than ``over`` distinct resources.

    The window slides over the key's events in one ordered pass; no set is built per event.
    """
    return distinct_in_window(events, key, ts, resource, seconds, tie).where(F.col("n_distinct") > over)


def once_per_window(findings: DataFrame, key: list[str], ts: str, seconds: int, tie: str = "event_id") -> DataFrame:
    """The findings that remain when each silences its key's next ones for the window; the time of the last is carried."""
    return once(findings, key, ts, seconds, tie)


#: Fixed by the security model: codes of failed authentication, of invalid tokens and of revoked credentials.
AUTH_CODES = ["bad_secret", "unknown_principal", "bad_signature", "malformed_token", "expired"]
TOKEN_CODES = ["bad_signature", "malformed_token", "expired"]
REVOKED_CODES = ["token_revoked", "session_revoked", "principal_revoked"]
REPLAY_CODES = ["replay", "stale_request"]

def _single() -> dict[str, tuple[Column, str]]:
    """rule -> (condition on one event, severity): each such event is a finding."""
    code, kind, result = F.col("code"), F.col("kind"), F.col("result")
    request = kind == "request"
    return {
        "revoked_credential_use": (code.isin(REVOKED_CODES), "HIGH"),
        "replay": (code.isin(REPLAY_CODES), "HIGH"),
        "token_misuse": (code == "session_mismatch", "HIGH"),
        "integrity_monitor": ((kind == "integrity") & result.isin("deny", "error"), "CRITICAL"),
        "config_change": ((kind == "config") & (result != "allow"), "HIGH"),
        "deception": (request & F.col("resource").startswith("deception:"), "CRITICAL"),
        "privilege_escalation": (request & (result == "deny") & (code == "capability"), "HIGH"),
        "unexpected_key_usage": (request & (code == "key_mismatch"), "HIGH"),
    }


def single_findings(events: DataFrame) -> DataFrame:
    """event_id, session, rule, severity of events (kind, result, code, resource) that are findings by themselves."""
    rules = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (c, s) in _single().items()]))
    return events.select("event_id", "session", F.explode(rules).alias("r")).select("event_id", "session", "r.rule", "r.severity")


#: rule -> (condition, key, seconds, events in the window, severity); thresholds are fixed by the security model.
COUNTING = {
    "auth_failures": ("kind = 'auth' AND result = 'deny' AND code IN ('bad_secret', 'unknown_principal', 'bad_signature', 'malformed_token', 'expired')", "principal", 300, 5, "HIGH"),
    "invalid_tokens": ("kind = 'request' AND result = 'deny' AND code IN ('bad_signature', 'malformed_token', 'expired')", "session", 300, 5, "HIGH"),
    "request_rate": ("kind = 'request'", "session", 60, 121, "MEDIUM"),
    "authz_failures": ("kind = 'request' AND result = 'deny' AND code IN ('policy', 'capability')", "session", 300, 5, "HIGH"),
}
#: rule -> (condition, seconds, events from which on it escalates, severity below and from there).
ESCALATING = {
    "malformed_input": ("kind = 'request' AND result = 'error' AND code = 'malformed'", 300, 3, "MEDIUM", "HIGH"),
    "tamper": ("kind = 'request' AND result = 'error' AND code = 'integrity'", 300, 2, "HIGH", "CRITICAL"),
}


def counting_findings(events: DataFrame, rules: dict = COUNTING, scale: int = 1, suppress: bool = True) -> DataFrame:
    """event_id, rule, severity, n: events at which a rule's trailing window is full; one a window if ``suppress``.

    ``scale`` widens all windows (sparser logs).
    """
    out = None
    for name, (condition, key, seconds, least, severity) in rules.items():
        full = bursts(events.where(condition), [key], "ts", seconds * scale, least)
        if suppress:
            full = full.join(once_per_window(full, [key], "ts", seconds * scale), [key, "event_id"], "left_semi")
        rows = full.select("event_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("n_window").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def escalating_findings(events: DataFrame, rules: dict = ESCALATING, scale: int = 1) -> DataFrame:
    """event_id, rule, severity, n: every such event, graver once the session's window holds enough of them."""
    out = None
    for name, (condition, seconds, least, low, high) in rules.items():
        rows = counted(events.where(condition), ["session"], "ts", seconds * scale)
        rows = rows.select("event_id", F.lit(name).alias("rule"), F.when(F.col("n_window") >= least, high).otherwise(low).alias("severity"), F.col("n_window").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def session_changes(events: DataFrame, session: str, principal: str, ts: str, tie: str = "event_id") -> DataFrame:
    """Events whose principal differs from the session's first one: an aggregate and a join, no sort of the session."""
    first = events.groupBy(session).agg(F.min(F.struct(ts, tie, principal))[principal].alias("bound"))
    return events.join(first, session).where(F.col(principal) != F.col("bound"))


def risk(findings: DataFrame, subject: list[str], ts: str, severity: str, seconds: int = 900) -> DataFrame:
    """Adds score and level: points of the subject's findings in the trailing window."""
    score = F.sum(points(F.col(severity))).over(_trailing(subject, ts, seconds))
    return findings.withColumn("score", score).withColumn("level", risk_level(F.col("score")))


def risk_breakdown(findings: DataFrame, subject: str, category: str, severity: str) -> DataFrame:
    """subject, category, points with subtotals (a null category is the subject's total)."""
    return findings.rollup(subject, category).agg(F.sum(points(F.col(severity))).cast("long").alias("points")).where(F.col(subject).isNotNull())


LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _glob(pattern: Column) -> Column:
    """A shell pattern as a SQL LIKE pattern."""
    return F.replace(F.replace(F.replace(F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))


#: Operations that each system state permits before any rule is asked (fixed by the security model).
OPERATIONS = ["list", "verify", "locate", "read", "extract", "write", "admin", "recover"]
STATE_OPERATIONS = {
    "TRUSTED": OPERATIONS,
    "VERIFIED": OPERATIONS,
    "DEGRADED": ["list", "verify", "locate", "read", "extract", "admin", "recover"],
    "SUSPICIOUS": ["list", "verify", "admin", "recover"],
    "ISOLATED": ["admin", "recover"],
    "INTEGRITY_CHECK": ["recover"],
    "RECOVERY": ["recover"],
}
#: Rules of a policy, at most.
MAX_RULES = 1000


def decide(requests: DataFrame, rules: DataFrame, request_id: str = "event_id") -> DataFrame:
    """request id, allowed, rule (null where none decided).

    The state (req_state) has to permit the operation. Then any matching deny wins (the first); else the first matching
    allow whose integrity states (array) hold req_integrity and whose max_risk is at least req_risk; else denied.
    Rules: idx, effect, role, resource (glob), operation, integrity, max_risk; ``MAX_RULES`` at most, or this raises.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"a policy has at most {MAX_RULES} rules")
    rank = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    open_states = [f"{s}/{o}" for s, ops in STATE_OPERATIONS.items() for o in ops]
    permitted = F.concat_ws("/", "req_state", "req_operation").isin(open_states)
    joined = requests.withColumn("_permitted", permitted).join(
        F.broadcast(rules.withColumn("like", _glob(F.col("resource"))).drop("resource")),
        F.col("_permitted") & ((F.col("role") == "*") | (F.col("role") == F.col("req_role"))) & (F.col("operation") == F.col("req_operation")) & F.expr("req_resource LIKE like"),
        "left",
    )
    deny = F.min(F.when(F.col("effect") == "deny", F.col("idx")))
    fits = (F.col("effect") == "allow") & F.array_contains("integrity", F.col("req_integrity")) & (rank(F.col("req_risk")) <= rank(F.col("max_risk")))
    out = joined.groupBy(request_id).agg(deny.alias("d"), F.min(F.when(fits, F.col("idx"))).alias("a"))
    return out.select(request_id, (F.col("d").isNull() & F.col("a").isNotNull()).alias("allowed"), F.coalesce("d", "a").alias("rule"))


#: Allowed state transitions (fixed by the security model).
TRANSITIONS = {
    "TRUSTED": ["DEGRADED", "SUSPICIOUS", "ISOLATED", "INTEGRITY_CHECK"],
    "VERIFIED": ["TRUSTED", "DEGRADED", "SUSPICIOUS", "ISOLATED", "INTEGRITY_CHECK"],
    "DEGRADED": ["SUSPICIOUS", "ISOLATED", "INTEGRITY_CHECK"],
    "SUSPICIOUS": ["ISOLATED", "INTEGRITY_CHECK"],
    "ISOLATED": ["INTEGRITY_CHECK"],
    "INTEGRITY_CHECK": ["VERIFIED", "RECOVERY", "ISOLATED"],
    "RECOVERY": ["INTEGRITY_CHECK", "ISOLATED"],
}


def forbidden_transitions(states: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state cannot follow the one before (TRUSTED before the first); staying is allowed."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit("TRUSTED"))
    allowed = F.lit(False)
    for a, following in TRANSITIONS.items():
        allowed = allowed | ((F.col("_before") == a) & F.col(state).isin(a, *following))
    return states.withColumn("_before", before).where(~allowed).withColumnRenamed("_before", "came_from")
