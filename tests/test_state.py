"""Stateful streams against brute force and their batch forms: rows out of order, a restart from the checkpoint, timers, and state that goes."""

import random
import tempfile
import time
import uuid

import pytest
from pyspark.sql import functions as F

from shelfmark.streaming import alerts, state

KIND = "event_id long, identity long, route string, status int, at_s long"
T0 = 1_704_067_200


@pytest.fixture(autouse=True)
def store(spark):
    state.ready(spark)


class Stream:
    """A stream over folders that get a file for each part; each run takes what is new and ends."""

    def __init__(self, spark, make):
        self.spark, self.make, self.top, self.n = spark, make, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 0
        self.progress = []

    def run(self, *parts):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{self.top}/in")
            self.n += 1
            time.sleep(0.05)
        rows = self.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{self.top}/in")
        q = self.make(rows).writeStream.format("parquet").option("path", f"{self.top}/out").option("checkpointLocation", f"{self.top}/check").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        self.progress += [p for p in q.recentProgress]
        return self

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.top}/out").collect())

    def kept(self):
        return [s["numRowsTotal"] for s in self.progress[-1]["stateOperators"]]


def made(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_seconds("at_s")).drop("at_s")


def shuffled(rng, n, span=3000, late=500):
    """Rows whose arrival is out of order by `late` seconds at most, in three parts, and a row far ahead that lets the watermark pass them all."""
    rows = [(i, rng.randrange(4), f"r{rng.randrange(3)}", rng.choice([200, 200, 404, 503]), T0 + rng.randrange(span)) for i in range(n)]
    by = sorted(rows, key=lambda r: r[4] + rng.randrange(late))
    cut = n // 3
    return rows, by[:cut], by[cut : 2 * cut], by[2 * cut :], [(n, 99, "end", 200, T0 + 100_000), (n + 1, 99, "end", 200, T0 + 100_001)]


def test_rate_limit(spark):
    rows, *parts = shuffled(random.Random(1), 240)
    limit, window, kept, want = 3, 200, {}, []
    for event, who, _, _, at in sorted(rows, key=lambda r: (r[4], r[0])):
        start, n = kept.get(who, (None, 0))
        if start is None or at >= start + window:
            start, n = at, 0
        kept[who] = (start, n + 1)
        want.append((event, who, start + window - at if n + 1 > limit else 0))
    s = Stream(spark, lambda d: state.limited(alerts.late(d), limit, window))
    frames = [made(spark, p) for p in parts]
    s.run(frames[0], frames[1])  # ends, and goes on from the checkpoint
    s.run(frames[2], frames[3].limit(1))
    s.run(frames[3].limit(1))
    assert [r for r in s.rows() if r[1] != 99] == sorted(want) and any(r[2] for r in want)
    batch = alerts.limited(made(spark, rows), limit, window).collect()
    assert {(r["event_id"], r["wait_s"]) for r in batch} == {(e, w) for e, _, w in want}
    assert s.kept()[0] <= 8  # rows, value and timers of the last identity alone


def test_late_rows_are_dropped(spark):
    early = made(spark, [(1, 1, "r", 200, T0), (2, 1, "r", 200, T0 + 5000)])
    s = Stream(spark, lambda d: state.limited(alerts.late(d), 1, 60))
    s.run(early, made(spark, [(3, 1, "r", 200, T0 + 5001)]), made(spark, [(4, 1, "r", 200, T0 + 1)]), made(spark, [(5, 2, "r", 200, T0 + 90_000)]), made(spark, [(6, 2, "r", 200, T0 + 90_001)]))
    assert [r[0] for r in s.rows() if r[1] == 1] == [1, 2, 3]


def told(spark, rows):
    return spark.createDataFrame(rows, "rule string, met boolean, at_s long").withColumn("ts", F.timestamp_seconds("at_s")).drop("at_s")


def test_alerts_fire_without_a_new_row_and_reset(spark):
    rows = [("a", True, T0), ("a", True, T0 + 60), ("b", True, T0 + 10), ("b", False, T0 + 200), ("b", True, T0 + 260), ("b", True, T0 + 700), ("b", False, T0 + 900), ("c", False, T0 + 5), ("d", True, T0 + 30), ("d", False, T0 + 330)]
    first, second = rows[:3] + rows[7:8], [rows[4], rows[3], rows[8], rows[9], *rows[5:7]]
    make = lambda d: state.held(d.withWatermark("ts", "10 minutes"), 300)
    s = Stream(spark, make).run(told(spark, first), told(spark, second))
    s.run(told(spark, [("z", False, T0 + 9000)]), told(spark, [("z", False, T0 + 9001)]))
    want = [("a", "firing", T0 + 300, T0), ("b", "firing", T0 + 560, T0 + 260), ("b", "resolved", T0 + 900, T0 + 260)]  # d: unmet just when its time had come
    assert s.rows() == want
    batch = sorted(tuple(r) for r in alerts.transitions(told(spark, rows + [("z", False, T0 + 9000)]), 300).collect())
    assert batch == want


def test_alerts_behind_windows(spark):
    """The rule of T2, its windows and the state machine in one stream."""
    rows, *parts = shuffled(random.Random(5), 300, 6000)
    frames = [made(spark, p) for p in parts]
    make = lambda d: state.held(alerts.evaluations(alerts.late(d), 0.2), 240)
    s = Stream(spark, make).run(*frames[:3]).run(frames[3].limit(1)).run(frames[3].limit(1))
    want = sorted(tuple(r) for r in alerts.transitions(alerts.evaluations(alerts.timed(made(spark, rows)), 0.2), 240).collect())
    got = s.rows()
    assert want and set(want) <= set(got) and all(r[1] == "firing" for r in set(got) - set(want))  # pending at the end of the batch


def test_status_changes(spark):
    rows, *parts = shuffled(random.Random(2), 300)
    frames = [made(spark, p) for p in parts]
    make = lambda d: state.status_changes(alerts.late(d), 10, 1)
    s = Stream(spark, make).run(*frames[:2]).run(frames[2], frames[3].limit(1)).run(frames[3].limit(1))
    want = sorted(tuple(r) for r in alerts.status_changes(made(spark, rows), 10, 1).collect())
    assert [r for r in s.rows() if r[0] != "end"] == want and len(want) > 100


def test_flips_across_buckets(spark):
    """A hot key is cut by time; borders lose nothing, also over empty buckets."""
    rng = random.Random(3)
    rows = [(i, 0, "hot", rng.choice([200, 503]), T0 + rng.choice([rng.randrange(300), 50_000 + rng.randrange(300)])) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    order = sorted(rows, key=lambda r: (r[4], r[0]))
    want = {(b[0], a[3]) for a, b in zip(order, order[1:]) if a[3] != b[3]} | {(order[0][0], None)}
    for bucket in (1, 50, 3600, 10**7):
        assert {(r["event_id"], r["before"]) for r in alerts.flips(df, "route", "status", ("at_s", "event_id"), bucket).collect()} == want


def test_cooling(spark):
    rows, *parts = shuffled(random.Random(4), 260)
    frames = [made(spark, p) for p in parts]

    def make(d):
        return state.cooling(alerts.late(d), alerts.late(d.where("status >= 500")), 120)

    s = Stream(spark, make).run(*frames[:2]).run(frames[2], frames[3].limit(1)).run(frames[3].limit(1))
    s.run(made(spark, [(9998, 98, "x", 503, T0 + 200_000)]), made(spark, [(9999, 98, "x", 503, T0 + 200_001)]))
    order, want = sorted(rows, key=lambda r: (r[4], r[0])), []
    for i, r in enumerate(order):
        failed = [x[4] for x in order[:i] if x[1] == r[1] and x[3] >= 500]
        if failed and r[4] - max(failed) <= 120:
            want.append((r[0], r[1], r[4] - max(failed)))
    assert [r for r in s.rows() if r[1] < 90] == sorted(want) and want
    assert sorted(tuple(r) for r in alerts.cooling(made(spark, rows), 120).collect()) == sorted(want)
    assert sum(s.kept()) < 30  # what is older than the interval and the watermark is gone


def test_sessions(spark):
    at = lambda *ts: spark.createDataFrame([(w, T0 + t) for w, t in ts], "worker string, at_s long").withColumn("ts", F.timestamp_seconds("at_s")).drop("at_s")
    first, second = at(("a", 0), ("a", 200), ("b", 0), ("b", 119)), at(("a", 100), ("c", 5))  # the late row of a joins two sessions
    s = Stream(spark, lambda d: state.sessions(d.withWatermark("ts", "10 minutes"))).run(first).run(second).run(at(("z", 9000))).run(at(("z", 9001)))
    want = sorted(tuple(r) for r in state.sessions(first.unionByName(second)).collect())
    assert want == [("a", T0, T0 + 200, 3), ("b", T0, T0 + 119, 2), ("c", T0 + 5, T0 + 5, 1)]
    assert [r for r in s.rows() if r[0] != "z"] == want


def test_stalled_by_the_clock(spark):
    """A run that falls silent is told without a new row, one that goes on isn't, and one that ends leaves nothing."""
    top, name = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), f"stalled_{uuid.uuid4().hex}"
    beat = lambda *rows: spark.createDataFrame([(r, st, time.time() + d) for r, st, d in rows], "run_id long, status string, t double").select("run_id", "status", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(f"{top}/in")
    beat((1, "running", 0), (2, "running", 0), (3, "running", 0), (4, "running", -100))
    rows = spark.readStream.schema("run_id long, status string, ts timestamp").parquet(f"{top}/in")
    q = state.stalled(rows, 20).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{top}/check").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 18
        while time.time() < until and spark.table(name).count() < 1:
            time.sleep(0.3)
        beat((2, "running", 3000), (3, "completed", 1))
        until = time.time() + 60
        while time.time() < until and spark.table(name).count() < 2:
            time.sleep(0.5)
        assert sorted(r["run_id"] for r in spark.table(name).collect()) == [1, 4]
        assert all(r["age_s"] >= 20 for r in spark.table(name).collect())
    finally:
        q.stop()
