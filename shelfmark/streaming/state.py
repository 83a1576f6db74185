"""Stateful streams (T1, T4, T5, T7, T8 and worker sessions) with keyed state, timers and watermarks.

Rows may come out of order. `InOrder` holds a key's rows until the watermark
has passed them, walks them by time, and keeps what its walk wants to remember;
a walk that remembers nothing leaves no state. Rows behind the watermark of the
batch before are dropped by Spark. `ready` sets the state store that keyed state needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIVE = ("pending", "inventorying", "running", "cancelling")


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """`row`: the schema of what is held of a row, `at_ms long` first; `kept`: of what a walk remembers; `out`: of what it puts out."""

    row: str
    kept: str
    out: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.row)
        self.held = handle.getValueState("held", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in self.row.split(", ")]
        for part in rows:
            new = list(zip(*(part[n].tolist() for n in names)))
            self.rows.appendList(new)
            for at in {r[0] for r in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=list(self.out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.rows.get())
        later = [r for r in rows if r[0] > now]
        if later:
            self.rows.put(later)
        else:
            self.rows.clear()
        held = tuple(self.held.get()) if self.held.exists() else None
        told, held, wake = self.walk(key[0], held, rows[: len(rows) - len(later)], now)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        if wake is not None and wake > now:
            self.handle.registerTimer(wake)
        yield pd.DataFrame(told, columns=list(self.out))

    def walk(self, key, held: tuple | None, rows: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        """What a key's next rows say, what is remembered after them, and when to look again without a row (milliseconds)."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Limit(InOrder):
    row, kept, out = "at_ms long, event_id long", "start_ms long, n long", ("event_id", "identity", "wait_s")

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window * 1000

    def walk(self, key, held, rows, now):
        told, (start, n) = [], held or (None, 0)
        for at, event in rows:
            if start is None or at >= start + self.window:
                start, n = at, 0
            n += 1
            told.append((event, key, (start + self.window) // 1000 - at // 1000 if n > self.limit else 0))
        over = start is None or start + self.window <= now
        return told, None if over else (start, n), None if over else start + self.window


def limited(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """T1 on a stream: what the batch form gives, each row once the watermark has passed it. `requests`: event_id, identity, ts with a watermark."""
    rows = requests.select("identity", "ts", "event_id", _seconds_ms("ts"))
    return rows.groupBy("identity").transformWithStateInPandas(Limit(limit, window), "event_id long, identity long, wait_s long", "Append", "EventTime")


def _seconds_ms(ts: str):
    """Whole seconds, as the batch forms count them, in milliseconds."""
    return (F.unix_seconds(ts) * 1000).alias("at_ms")


class Hold(InOrder):
    row, kept, out = "at_ms long, met boolean", "since_ms long, fired boolean", ("rule", "state", "at_s", "since_s")

    def __init__(self, seconds: int):
        self.wait = seconds * 1000

    def walk(self, key, held, rows, now):
        told, (since, fired) = [], held or (None, False)

        def fire(until: int, through: bool) -> bool:
            due = since is not None and not fired and (since + self.wait < until or through and since + self.wait == until)
            if due:
                told.append((key, "firing", (since + self.wait) // 1000, since // 1000))
            return fired or due

        for at, met in rows:
            fired = fire(at, met)
            if met and since is None:
                since, fired = at, False
            elif not met and since is not None:
                if fired:
                    told.append((key, "resolved", at // 1000, since // 1000))
                since, fired = None, False
        fired = fire(now, True)
        return told, None if since is None else (since, fired), None if since is None or fired else since + self.wait


def held(evaluations: DataFrame, seconds: int) -> DataFrame:
    """T4 on a stream: `evaluations` (rule, ts with a watermark, met). A rule that is met stays pending, fires `seconds` after its first met
    evaluation, also if no row of its own comes by then, and is resolved by the first one that isn't met. No evaluation, no change."""
    rows = evaluations.select("rule", "ts", "met", _seconds_ms("ts"))
    return rows.groupBy("rule").transformWithStateInPandas(Hold(seconds), "rule string, state string, at_s long, since_s long", "Append", "EventTime")


class Changes(InOrder):
    row, kept, out = "at_ms long, event_id long, status int", "status int", ("route", "ts")

    def walk(self, key, held, rows, now):
        told, last = [], held[0] if held else None
        for at, _, status in rows:
            if last is not None and status != last:
                told.append((key, pd.Timestamp(at, unit="ms")))
            last = status
        return told, None if last is None else (last,), None


def status_changes(requests: DataFrame, minutes: int = 10, slide: int = 1) -> DataFrame:
    """T8 on a stream: the last status of a route is kept across batches; changes are counted in sliding windows behind that state.

    A change counts at the whole second of its request. `requests`: event_id, route, status, ts with a watermark.
    """
    rows = requests.select("route", "ts", "event_id", F.col("status").cast("int").alias("status"), _seconds_ms("ts"))
    changed = rows.groupBy("route").transformWithStateInPandas(Changes(), "route string, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts")
    by = changed.groupBy("route", F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(F.count("*").alias("changes"))
    return by.select("route", F.unix_seconds("w.start").alias("start_s"), "changes")


class Stall(StatefulProcessor):
    """The last sign of life of a run, with a processing-time timer."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def _told(self, key, now: int) -> pd.DataFrame:
        at = self.last.get()[0]
        return pd.DataFrame([(key[0], at // 1000, (now - at) // 1000)] if now - at >= self.wait else [], columns=["run_id", "last_s", "age_s"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max((tuple(r) for part in rows for r in zip(part["at_ms"].tolist(), part["status"].tolist())), default=None)
        seen = self.last.get()[0] if self.last.exists() else None
        if newest is None or seen is not None and newest[0] < seen:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if newest[1] not in ACTIVE:
            self.last.clear()
            return
        self.last.update((newest[0],))
        now = timerValues.getCurrentProcessingTimeInMs()
        if newest[0] + self.wait > now:
            self.handle.registerTimer(newest[0] + self.wait)
        yield self._told(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            yield self._told(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stalled(heartbeats: DataFrame, seconds: int = 600) -> DataFrame:
    """T5 on a stream: active runs without a sign of life for `seconds` by the clock, once for each silence. `heartbeats`: run_id, status, ts. Runs that end leave no state."""
    rows = heartbeats.select("run_id", "status", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("run_id").transformWithStateInPandas(Stall(seconds), "run_id long, last_s long, age_s long", "Append", "ProcessingTime")


def sessions(heartbeats: DataFrame, lease: int = 120) -> DataFrame:
    """Worker sessions, split where no heartbeat comes within the lease; for batch and stream, where a late row may join two. `heartbeats`: worker, ts."""
    by = heartbeats.groupBy("worker", F.session_window("ts", f"{lease} seconds").alias("w")).agg(F.count("*").alias("beats"))
    return by.select("worker", F.unix_seconds("w.start").alias("start_s"), (F.unix_seconds("w.end") - lease).alias("last_s"), "beats")


def cooling(requests: DataFrame, failures: DataFrame, seconds: int = 300) -> DataFrame:
    """T7 on streams: requests within `seconds` after a 5xx answer of their identity, with the time since the last one.

    An interval join with watermarks on both sides: the state holds `seconds` and the watermark's delay of either. `failures`: the 5xx rows of the same shape.
    """
    r = requests.select("event_id", "identity", "ts", F.unix_seconds("ts").alias("at_s"))
    f = failures.select(F.col("event_id").alias("f_id"), F.col("identity").alias("f_identity"), F.col("ts").alias("f_ts"), F.unix_seconds("ts").alias("f_s"))
    before = (F.col("f_s") < F.col("at_s")) | (F.col("f_s") == F.col("at_s")) & (F.col("f_id") < F.col("event_id"))
    span = F.expr(f"f_ts >= ts - INTERVAL {seconds + 1} SECONDS AND f_ts <= ts + INTERVAL 1 SECOND")
    pairs = r.join(f, (F.col("identity") == F.col("f_identity")) & span & before & (F.col("at_s") - F.col("f_s") <= seconds))
    last = pairs.groupBy("ts", "event_id", "identity", "at_s").agg(F.max("f_s").alias("f_s"))
    return last.select("event_id", "identity", (F.col("at_s") - F.col("f_s")).alias("after_s"))
