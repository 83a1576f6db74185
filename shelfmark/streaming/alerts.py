"""Alerts and limits over events (T1-T9). T2, T3, T6 and T9 take a batch or a stream; on a stream put `late` in front, which drops rows more than ten minutes behind. The streams of T1, T4, T5, T7 and T8 are in `state`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATE = "10 minutes"


def timed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("ts", F.col("ts").cast("timestamp"))


def late(requests: DataFrame) -> DataFrame:
    """Watermark policy of all streams here."""
    return timed(requests).withWatermark("ts", LATE)


def request_windows(requests: DataFrame) -> DataFrame:
    """Five-minute windows, one each minute: requests, 5xx answers and total seconds."""
    by = requests.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"))
    out = by.agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"), F.sum("duration_s").alias("seconds"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "n", "errors", "seconds")


def error_windows(requests: DataFrame, share: float = 0.05) -> DataFrame:
    """Windows with more than `share` of 5xx answers."""
    return request_windows(requests).where(F.col("errors") / F.col("n") > share).select("start_s", "n", "errors")


def slow_windows(requests: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Windows whose mean duration is above `seconds`."""
    return request_windows(requests).where(F.col("seconds") / F.col("n") > seconds).select("start_s", "n", F.round(F.col("seconds") / F.col("n"), 6).alias("mean_s"))


def held(windows: DataFrame, seconds: int = 600, step: int = 60) -> DataFrame:
    """T4: the windows of an alert (rule, start_s) at which its condition has held for `seconds`: islands of consecutive windows."""
    w = Window.partitionBy("rule").orderBy("start_s")
    island = windows.withColumn("island", F.col("start_s") - step * F.row_number().over(w))
    since = F.min("start_s").over(Window.partitionBy("rule", "island"))
    return island.withColumn("since_s", since).where(F.col("start_s") - F.col("since_s") >= seconds).select("rule", "start_s", "since_s")


def flips(rows: DataFrame, key: str, value: str, order: tuple[str, ...], bucket: int = 3600) -> DataFrame:
    """Rows whose value differs from that of the row before (`before`), and the first row of each key. `order`: at_s and what breaks its ties.

    A key may hold most of the rows: they are compared inside buckets of time, and the buckets' last values with each other.
    """
    rows = rows.withColumn("bucket", F.floor(F.col(order[0]) / bucket))
    w = Window.partitionBy(key, "bucket").orderBy(*order)
    inner = rows.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag(value).over(w))
    last = rows.groupBy(key, "bucket").agg(F.max_by(value, F.struct(*order)).alias("last"))
    border = last.select(key, "bucket", F.lag("last").over(Window.partitionBy(key).orderBy("bucket")).alias("border"))
    told = inner.where((F.col("place") > 1) & (F.col("before") != F.col(value))).select(*rows.columns, "before")
    first = inner.where("place = 1").drop("before").join(border, [key, "bucket"]).where(F.col("border").isNull() | (F.col("border") != F.col(value)))
    return told.unionByName(first.select(*rows.columns, F.col("border").alias("before"))).drop("bucket")


def evaluations(requests: DataFrame, share: float = 0.05) -> DataFrame:
    """What the rule of T2 says at the end of each five-minute window: rule, ts, met."""
    by = requests.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("errors"))
    return by.select(F.lit("errors").alias("rule"), F.window_time("w").alias("ts"), (F.col("errors") / F.col("n") > share).alias("met"))


def transitions(told: DataFrame, seconds: int) -> DataFrame:
    """T4: when rules (rule, ts, met) fire, `seconds` after their first met evaluation with none unmet until then, and when they are resolved.

    What is pending after the last evaluation of all has fired if its time had come by then.
    """
    rows = told.select("rule", "met", F.unix_seconds("ts").alias("at_s"))
    edge = flips(rows, "rule", "met", ("at_s",))
    runs = edge.withColumn("end_s", F.lead("at_s").over(Window.partitionBy("rule").orderBy("at_s"))).where("met")
    fired_s = F.col("at_s") + seconds
    fired = runs.crossJoin(F.broadcast(rows.agg(F.max("at_s").alias("now_s")))).where((F.col("end_s").isNull() & (fired_s <= F.col("now_s"))) | (F.col("end_s") > fired_s))  # one row
    both = F.array(F.struct(F.lit("firing").alias("state"), fired_s.alias("at")), F.struct(F.lit("resolved").alias("state"), F.col("end_s").alias("at")))
    return fired.select("rule", F.col("at_s").alias("since_s"), F.inline(both)).where("at is not null").select("rule", "state", F.col("at").alias("at_s"), "since_s")


def stalled(runs: DataFrame, now_s: int, seconds: int = 600) -> DataFrame:
    """T5: active runs whose last sign of life is more than `seconds` back."""
    last = F.unix_seconds(F.coalesce("heartbeat_at", "started_at").cast("timestamp"))
    return runs.where(F.col("status").isin("pending", "inventorying", "running", "cancelling")).select("run_id", (F.lit(now_s) - last).alias("age_s")).where(F.col("age_s") > seconds)


def once(events: DataFrame, key: str) -> DataFrame:
    """Each event once; on a stream within the watermark."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def cooling(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """Requests of an identity within `seconds` after its last 5xx answer.

    That answer lies in the same span of `seconds` or in the one before, so no task has to hold an identity's whole past.
    """
    rows = requests.select("event_id", "identity", "status", F.unix_seconds("ts").alias("at_s")).withColumn("span", F.floor(F.col("at_s") / seconds))
    failed = F.when(F.col("status") >= 500, F.col("at_s"))
    w = Window.partitionBy("identity", "span").orderBy("at_s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.where("status >= 500").groupBy("identity", (F.col("span") + 1).alias("span")).agg(F.max("at_s").alias("before_s"))
    told = rows.withColumn("failed_s", F.max(failed).over(w)).join(before, ["identity", "span"], "left").withColumn("failed_s", F.coalesce("failed_s", "before_s"))
    return told.where(F.col("at_s") - F.col("failed_s") <= seconds).select("event_id", "identity", (F.col("at_s") - F.col("failed_s")).alias("after_s"))


def status_changes(requests: DataFrame, minutes: int = 10, slide: int = 1) -> DataFrame:
    """How often a route's status changed from one request to the next, in sliding windows of `minutes`; a change counts at the whole second of its request."""
    rows = requests.select("route", "event_id", "status", F.unix_seconds("ts").alias("at_s"))
    changed = flips(rows, "route", "status", ("at_s", "event_id")).where("before is not null").withColumn("ts", F.timestamp_seconds("at_s"))
    by = changed.groupBy("route", F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(F.count("*").alias("changes"))
    return by.select("route", F.unix_seconds("w.start").alias("start_s"), "changes")


def running_counts(verdicts: DataFrame) -> DataFrame:
    """Rows by run and action; on a stream in update mode."""
    return verdicts.groupBy("run_id", "action").agg(F.count("*").alias("n"))


def limited(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """Fixed windows that start at an identity's first request after the last window's end; requests over `limit` get the seconds that are left.

    Identities are dealt to partitions and sorted; a task walks its rows once with one window in hand, whatever an identity's size.
    """

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, n = None, 0.0, 0
        for part in parts:
            wait = []
            for identity, at in zip(part["identity"], part["at_s"]):
                if identity != who or at >= start + window:
                    who, start, n = identity, at, 0
                n += 1
                wait.append(int(start + window - at) if n > limit else 0)
            yield pd.DataFrame({"event_id": part["event_id"], "wait_s": wait})

    rows = requests.select("event_id", "identity", F.unix_seconds("ts").alias("at_s"))
    return rows.repartition("identity").sortWithinPartitions("identity", "at_s", "event_id").mapInPandas(walk, "event_id long, wait_s long")
