"""Stateful event detection: trailing windows per event and one finding a window, which no built-in frame gives in streams.

``detect`` keeps, per key, the times (and values) inside the window and the time of
the last finding. Events later than the watermark are dropped, which batch queries
do not do. State is bounded by the window and removed by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType


@dataclass(frozen=True)
class Rule:
    """A finding once the window holds ``least`` events, or ``least`` distinct values if ``distinct``."""

    name: str
    seconds: int
    least: int
    severity: str = "HIGH"
    distinct: bool = False
    once: bool = True


#: The counting rules and their thresholds (fixed by the security model).
RULES = {
    "auth_failures": Rule("auth_failures", 300, 5),
    "invalid_tokens": Rule("invalid_tokens", 300, 5),
    "request_rate": Rule("request_rate", 60, 121, "MEDIUM"),
    "access_pattern": Rule("access_pattern", 300, 51, "MEDIUM", distinct=True),
    "authz_failures": Rule("authz_failures", 300, 5),
}


def fold(rule: Rule, times: list[int], values: list[str], fired: int | None, events: list[tuple[int, str, int]]) -> tuple[list[int], list[str], int | None, list[tuple[int, int, int]]]:
    """(times, values, fired, findings) after ordered events (microseconds, value, id); findings: (id, time, count)."""
    found = []
    for at, value, event in events:
        times, values = [*times, at], [*values, value]
        k = next((i for i, t in enumerate(times) if t >= at - rule.seconds * 1_000_000), len(times))
        times, values = times[k:], values[k:]
        n = len(set(values)) if rule.distinct else len(times)
        if n >= rule.least and (not rule.once or fired is None or at - fired >= rule.seconds * 1_000_000):
            fired = at
            found.append((event, at, n))
    return times, values, fired, found


OUTPUT = StructType([StructField("key", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("n", LongType()), StructField("rule", StringType()), StructField("severity", StringType())])


class Detector(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", StructType([StructField("at", LongType()), StructField("value", StringType())]))
        self.fired = handle.getValueState("fired", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        events = sorted((int(t.value // 1000), str(v), int(e)) for t, v, e in zip(new["ts"], new["value"], new["event_id"], strict=True))
        events = [(t, v, e) for t, v, e in sorted(events, key=lambda x: (x[0], x[2]))]
        held = list(self.window.get()) if self.window.exists() else []
        fired = self.fired.get()[0] if self.fired.exists() else None
        times, values, fired, found = fold(self.rule, [h[0] for h in held], [h[1] for h in held], fired, events)
        self.window.put(list(zip(times, values, strict=True)))
        if fired is not None:
            self.fired.update((fired,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(times[-1] // 1000 + self.rule.seconds * 1000 + 1)
        yield self._frame(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        self.fired.clear()
        yield self._frame(key[0], [])

    def _frame(self, key: str, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        n = len(found)
        return pd.DataFrame({
            "key": pd.Series([key] * n, dtype="object"), "event_id": pd.Series([f[0] for f in found], dtype="int64"),
            "ts": pd.Series(pd.to_datetime([f[1] for f in found], unit="us"), dtype="datetime64[ns]"), "n": pd.Series([f[2] for f in found], dtype="int64"),
            "rule": pd.Series([self.rule.name] * n, dtype="object"), "severity": pd.Series([self.rule.severity] * n, dtype="object"),
        })

    def close(self) -> None:
        pass


def detect(events: DataFrame, rule: Rule, key: str, ts: str = "ts", value: str = "value", event_id: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Findings of a stream of events. Needs the RocksDB state store provider."""
    shaped = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("string").alias("value"), F.col(event_id).cast("long").alias("event_id"))
    return shaped.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Detector(rule), OUTPUT, "Append", "eventTime")


def first_seen(requests: DataFrame, nonce: list[str], ts: str = "ts", window: str = "600 seconds") -> DataFrame:
    """Requests whose nonce was not seen within the window (replays are dropped)."""
    return requests.withWatermark(ts, window).dropDuplicatesWithinWatermark(nonce)


def session_counts(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per session of a key: sessions end after ``gap`` without events."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def tumbling_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")
