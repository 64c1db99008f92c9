"""Session binding, trailing risk and replay protection as streams, and a listener for progress (ST10, ST11, ST13, ST14 rows).

State is kept per key and bounded: a session's first principal, the findings of
the risk window, the nonces of the replay window. Timers remove it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

POINTS = {"INFO": 0, "LOW": 5, "MEDIUM": 20, "HIGH": 50, "CRITICAL": 80}
#: Fixed by the security model: seconds of the risk window, of the replay window and of clock skew; nonces kept of a key.
RISK_WINDOW, REPLAY_WINDOW, SKEW, CAPACITY = 900, 600, 120, 100_000
MICRO = 1_000_000


def _field(name: str, kind) -> StructField:
    return StructField(name, kind)


def _micros(frame: pd.DataFrame, column: str) -> list[int]:
    return [int(t.value // 1000) for t in frame[column]]


class _Timed(StatefulProcessor):
    """Removes a key's state once nothing in it can matter."""

    keep_seconds = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states()

    def states(self) -> None:
        raise NotImplementedError

    def cleared(self) -> pd.DataFrame:
        raise NotImplementedError

    def keep_until(self, last: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(last // 1000 + self.keep_seconds * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.cleared()

    def close(self) -> None:
        pass


class _Bound(_Timed):
    keep_seconds = 86_400

    def states(self) -> None:
        self.first = self.handle.getValueState("first", StructType([_field("principal", StringType())]))

    def _frame(self, key: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"session": pd.Series([key] * len(rows), dtype="object"), "event_id": pd.Series([r[0] for r in rows], dtype="int64"), "principal": pd.Series([r[1] for r in rows], dtype="object"), "bound": pd.Series([r[2] for r in rows], dtype="object")})

    def cleared(self) -> pd.DataFrame:
        self.first.clear()
        return self._frame("", [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        bound = self.first.get()[0] if self.first.exists() else str(new["principal"].iloc[0])
        self.first.update((bound,))
        self.keep_until(max(_micros(new, "ts")))
        yield self._frame(key[0], [(int(e), p, bound) for e, p in zip(new["event_id"], new["principal"], strict=True) if p != bound])


def session_changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """session, event_id, principal, bound of events (session, principal, ts, event_id) whose principal is not the session's first."""
    schema = StructType([_field("session", StringType()), _field("event_id", LongType()), _field("principal", StringType()), _field("bound", StringType())])
    return events.select("session", "principal", "ts", "event_id").withWatermark("ts", late).groupBy("session").transformWithStateInPandas(_Bound(), schema, "Append", "eventTime")


class _Risk(_Timed):
    keep_seconds = RISK_WINDOW

    def states(self) -> None:
        self.window = self.handle.getListState("window", StructType([_field("at", LongType()), _field("points", LongType())]))

    def _frame(self, key: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"subject": pd.Series([key] * len(rows), dtype="object"), "event_id": pd.Series([r[0] for r in rows], dtype="int64"), "score": pd.Series([r[1] for r in rows], dtype="int64"), "level": pd.Series([level(r[1]) for r in rows], dtype="object")})

    def cleared(self) -> pd.DataFrame:
        self.window.clear()
        return self._frame("", [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = [(h[0], h[1]) for h in self.window.get()] if self.window.exists() else []
        out = []
        for at, event, severity in zip(_micros(new, "ts"), new["event_id"], new["severity"], strict=True):
            held = [h for h in held if h[0] >= at - RISK_WINDOW * MICRO] + [(at, POINTS.get(severity, 0))]
            out.append((int(event), sum(p for _, p in held)))
        self.window.put(held)
        self.keep_until(held[-1][0])
        yield self._frame(key[0], out)


def level(score: int) -> str:
    return "CRITICAL" if score >= 80 else "HIGH" if score >= 50 else "MEDIUM" if score >= 20 else "LOW"


def risk(findings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """subject, event_id, score, level after each finding (subject, severity, ts, event_id): points of the last 900 seconds."""
    schema = StructType([_field("subject", StringType()), _field("event_id", LongType()), _field("score", LongType()), _field("level", StringType())])
    return findings.select("subject", "severity", "ts", "event_id").withWatermark("ts", late).groupBy("subject").transformWithStateInPandas(_Risk(), schema, "Append", "eventTime")


class _Replay(_Timed):
    keep_seconds = REPLAY_WINDOW

    def states(self) -> None:
        self.seen = self.handle.getListState("seen", StructType([_field("nonce", StringType()), _field("at", LongType())]))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pd.Series([r[0] for r in rows], dtype="int64"), "refused": pd.Series([r[1] for r in rows], dtype="object")})

    def cleared(self) -> pd.DataFrame:
        self.seen.clear()
        return self._frame([])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = dict((h[0], h[1]) for h in self.seen.get()) if self.seen.exists() else {}
        out = []
        for now, event, nonce, claimed in zip(_micros(new, "ts"), new["event_id"], new["nonce"], _micros(new, "claimed"), strict=True):
            if not isinstance(nonce, str) or not 16 <= len(nonce) <= 128:
                out.append((int(event), "malformed_nonce"))
                continue
            if abs(now - claimed) > SKEW * MICRO:
                out.append((int(event), "stale_request"))
                continue
            while held and ((first := next(iter(held.items())))[1] < now - REPLAY_WINDOW * MICRO or len(held) >= CAPACITY):
                del held[first[0]]
            if nonce in held:
                out.append((int(event), "replay"))
            else:
                held[nonce] = now
                out.append((int(event), None))
        self.seen.put(list(held.items()) or [("", 0)])
        self.keep_until(max(_micros(new, "ts")))
        yield self._frame(out)


def replay_guard(requests: DataFrame, late: str = "10 minutes", parts: int = 256) -> DataFrame:
    """event_id, refused (null, malformed_nonce, stale_request or replay) of every request (nonce, claimed, ts, event_id).

    Requests are accepted once a window per nonce, and only near the time that they claim. Nonces are
    kept in ``parts`` keys by their hash, so that state is spread over tasks; the capacity is a key's.
    """
    keyed = requests.select("nonce", "claimed", "ts", "event_id", F.pmod(F.xxhash64("nonce"), F.lit(parts)).cast("string").alias("part"))
    schema = StructType([_field("event_id", LongType()), _field("refused", StringType())])
    return keyed.withWatermark("ts", late).groupBy("part").transformWithStateInPandas(_Replay(), schema, "Append", "eventTime")


class Progress(StreamingQueryListener):
    """Keeps what each batch of a query told: add it with ``spark.streams.addListener``."""

    def __init__(self, most: int = 1000):
        self.rows: list[dict] = []
        self.most, self.ended = most, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows = [*self.rows[1 - self.most :], {"name": p.name, "batch": p.batchId, "rows": p.numInputRows}]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1


def by_tag(reads: DataFrame, folder: str, checkpoint: str, profile: str = "v4-balanced"):
    """Start scanning a stream of reads (seq, qual) into tables by archive tag; each read is scanned once (ST3). Returns the query.

    A shuffled pool is then decoded tag by tag from its own folder, without a pass over the whole pool for each.
    """
    from ..plans import codec

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("read"), "seq", "qual")
        found = codec.scan(rows, profile).where("ok").select("ok", "kind", "tag", "grp", "symbol", "payload")
        found.write.mode("overwrite").partitionBy("tag").parquet(f"{folder}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
