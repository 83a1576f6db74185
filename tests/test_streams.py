"""Streams give what the batch forms give, out-of-order rows included; rows behind the watermark are dropped."""

import tempfile

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import records
from shelfmark.sources.catalogue import view
from shelfmark.streaming import alerts

SF = "/root/testdata/sf0.001"
KIND = "event_id long, ts timestamp, identity long, route string, status int, duration_s double"


def stream(spark, parts, make, mode, key=None):
    """The rows that a stream over the parts, one a batch, has put out in the end."""
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{top}/in/{i}")
    name = "out_" + top.rsplit("-", 1)[-1].replace("-", "_")
    out = None
    for i in range(len(parts)):  # a glob that grows makes each part a batch of its own, in order
        spark.sql(f"DROP VIEW IF EXISTS {name}{i}")
    rows = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{top}/in/*")
    q = make(rows).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start()
    q.awaitTermination(180)
    out = spark.table(name)
    return out if key is None else out.groupBy(*key).agg(F.max("n").alias("n"))


@pytest.fixture(scope="module")
def requests(spark):
    return alerts.timed(view(spark, SF, "requests")).select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("identity").cast("long").alias("identity"), "route", F.col("status").cast("int").alias("status"), F.col("duration_s").cast("double").alias("duration_s"))


def test_windows_with_late_and_unordered_rows(spark):
    at = lambda m, s=0: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:{s:02d}"
    make = lambda rows: spark.createDataFrame([(i, t, 1, "r", st, 3.0) for i, t, st in rows], "event_id long, ts string, identity long, route string, status int, duration_s double").withColumn("ts", F.to_timestamp("ts"))
    first = make([(1, at(60), 200), (2, at(61), 503), (3, at(59), 503)])
    second = make([(4, at(58), 200), (5, at(90), 200)])  # 58 is out of order, within ten minutes of 61
    third = make([(7, at(91), 200)])
    fourth = make([(6, at(60), 503), (8, at(200), 200)])  # 60 is more than ten minutes behind 90, the latest of two batches before
    for f in (alerts.error_windows, alerts.slow_windows):
        got = {tuple(r) for r in stream(spark, [first, second, third, fourth], lambda s, f=f: f(alerts.late(s)), "append").collect()}
        want = {tuple(r) for r in f(first.unionByName(second).unionByName(third).unionByName(fourth.where("event_id <> 6"))).collect()}
        closed = {w for w in want if w[0] + 300 <= 1704067200 + 190 * 60}
        assert got == closed and closed


def test_once_and_counts(spark, requests):
    parts = [requests.where("event_id % 2 = 0"), requests]
    got = stream(spark, parts, lambda s: alerts.once(s.withWatermark("ts", "60 days"), "event_id"), "append")
    assert got.count() == requests.count() == alerts.once(parts[0].unionByName(parts[1]), "event_id").count()
    as_runs = lambda d: d.select((F.col("event_id") % 5).alias("run_id"), F.col("route").alias("action"))
    got = stream(spark, [requests.where("event_id % 3 = 0"), requests.where("event_id % 3 <> 0")], lambda s: alerts.running_counts(as_runs(s)), "update", ("run_id", "action"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in alerts.running_counts(as_runs(requests)).collect()}


def test_new_files_once(spark):
    files = spark.createDataFrame([("/a/1.epub",), ("/a/2.txt",), ("/a/3.PDF",)], "path string")
    seen = spark.createDataFrame([("/a/1.epub",)], "path string")
    got = stream(spark, [files], lambda s: records.unseen(s, seen), "append")
    assert [r["path"] for r in got.collect()] == ["/a/3.PDF"]


def test_rate_limit_by_brute_force(spark, requests):
    limit, window = 2, 5 * 24 * 3600
    state, want = {}, {}
    for r in requests.select("event_id", "identity", F.unix_seconds("ts").alias("s")).orderBy("identity", "s", "event_id").collect():
        start, n = state.get(r["identity"], (None, 0))
        if start is None or r["s"] >= start + window:
            start, n = r["s"], 0
        n += 1
        state[r["identity"]] = (start, n)
        want[r["event_id"]] = start + window - r["s"] if n > limit else 0
    got = {r["event_id"]: r["wait_s"] for r in alerts.limited(requests, limit, window).collect()}
    assert got == want and any(want.values())
