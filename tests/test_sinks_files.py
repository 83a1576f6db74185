"""Sinks that run twice or fail half-way, and files as rows."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import files, sinks

EVIDENCE = "evidence_id string, payload_sha256 string, book_id long"


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_twice_and_after_a_failure(spark):
    path, kind = f"{fresh()}/books", "book_key string, title string, status string"
    first = spark.createDataFrame([(f"k{i}", f"t{i}", "new") for i in range(40)], kind)
    sinks.upsert(path, first, buckets=8)
    second = spark.createDataFrame([(f"k{i}", f"u{i}", "scanned") for i in range(20, 60)], kind)
    broken = second.withColumn("title", F.when(F.col("book_key") == "k59", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert(path, broken, buckets=8)
    want = sorted([(f"k{i}", f"t{i}", "new") for i in range(20)] + [(f"k{i}", f"u{i}", "scanned") for i in range(20, 60)])
    for _ in range(2):
        sinks.upsert(path, second, buckets=8)
        assert rows(spark.read.parquet(path).select("book_key", "title", "status")) == want
    before = {p: os.path.getmtime(f"{path}/{p}") for p in os.listdir(path) if p.startswith("bucket=")}
    sinks.upsert(path, second.where("book_key = 'k30'"), buckets=8)
    after = {p: sorted(os.listdir(f"{path}/{p}")) for p in before}
    assert len(after) == 8 and rows(spark.read.parquet(path).select("book_key", "title", "status")) == want


def test_insert_once(spark):
    path = f"{fresh()}/evidence"
    make = lambda *r: spark.createDataFrame(list(r), EVIDENCE)
    sinks.insert_once(path, make(("a", "1", 1), ("b", "2", 2), ("b", "2", 2)))
    both = make(("b", "2", 2), ("c", "3", 3))
    with pytest.raises(Exception, match="lost"):
        sinks.insert_once(path, both.withColumn("book_id", F.when(F.col("evidence_id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("book_id"))))
    for _ in range(2):
        sinks.insert_once(path, both)
        assert rows(spark.read.parquet(path)) == [("a", "1", 1), ("b", "2", 2), ("c", "3", 3)]
    for bad in (make(("a", "other", 1), ("d", "4", 4)), make(("e", "5", 5), ("e", "6", 5))):
        with pytest.raises(sinks.ConflictError):
            sinks.insert_once(path, bad)
    assert spark.read.parquet(path).count() == 3


def test_evidence_stream(spark):
    """A batch that fails in the sink runs again under its number; ids of other batches stay out; a conflict ends the stream."""
    top = fresh()
    add = lambda i, *r: spark.createDataFrame(list(r), EVIDENCE).coalesce(1).write.mode("append").parquet(f"{top}/in")
    sink, seen = sinks.evidence_sink(f"{top}/out", EVIDENCE), []

    def flaky(df, batch):
        sink(df, batch)
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("lost after writing")

    def run():
        q = spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", 1).parquet(f"{top}/in").writeStream.foreachBatch(flaky).option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)

    add(0, ("a", "1", 1), ("b", "2", 2))
    run()
    add(1, ("b", "2", 2), ("c", "3", 3))
    with pytest.raises(Exception, match="lost after writing"):
        run()
    run()
    assert seen == [0, 1, 1]
    assert rows(spark.read.parquet(f"{top}/out").select("evidence_id", "payload_sha256", "book_id")) == [("a", "1", 1), ("b", "2", 2), ("c", "3", 3)]
    add(2, ("a", "other", 1))
    with pytest.raises(Exception, match="another payload"):
        run()


def test_report(spark):
    top = fresh()
    verdicts = spark.createDataFrame([(1, "title", "confirmed", 90), (1, "isbn", "mismatch", 40), (2, "title", "missing", 0)], "book_id long, field string, verdict string, confidence int")
    for _ in range(2):
        sinks.write_report(top, "r1", verdicts)
        got = spark.read.schema("run_id string, book_id long, verdicts array<struct<field string, verdict string, confidence long>>").json(f"{top}/run=r1")
        assert [(r["run_id"], r["book_id"], [v["field"] for v in r["verdicts"]]) for r in got.orderBy("book_id").collect()] == [("r1", 1, ["isbn", "title"]), ("r1", 2, ["title"])]


@pytest.fixture(scope="module")
def library():
    top = fresh()
    big = os.urandom(300_000)
    twin = big[:150_000] + bytes([big[150_000] ^ 1]) + big[150_001:]  # ends alike, another middle
    for name, data in {"A/one.epub": b"abc", "A/two.EPUB": b"abc", "B/three.pdf": b"abd", "B/note.txt": b"abc", "B/big.pdf": big, "C/copy.pdf": big, "C/twin.pdf": twin, "C/none.mobi": b"", "C/nil.mobi": b"", "D/alone.cbz": b"x" * 77}.items():
        os.makedirs(f"{top}/{name.split('/')[0]}", exist_ok=True)
        with open(f"{top}/{name}", "wb") as f:
            f.write(data)
    return top


def _short(path):
    return "/".join(path.split("/")[-2:])


def test_listing_reads_no_content(spark, library):
    df = files.listed(spark, library)
    assert sorted(_short(r["path"]) for r in df.collect()) == ["A/one.epub", "A/two.EPUB", "B/big.pdf", "B/three.pdf", "C/copy.pdf", "C/twin.pdf", "D/alone.cbz"]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_clones_open_only_what_may_be_equal(spark, library):
    got = {_short(r["path"]): r for r in files.clones(files.listed(spark, library), 4).collect()}
    assert set(got) == {"A/one.epub", "A/two.EPUB", "B/big.pdf", "C/copy.pdf"}
    assert got["B/big.pdf"]["full"] == got["C/copy.pdf"]["full"] == hashlib.sha256(open(f"{library}/B/big.pdf", "rb").read()).hexdigest()
    assert files.sparse_hash(f"{library}/C/nil.mobi", 0) == "0:empty" and got["A/one.epub"]["sparse"] == "3:" + hashlib.sha256(b"3abc").hexdigest()[:16]
    assert files.sparse_hash(f"file:{library}/C/twin.pdf", 300_000) == got["B/big.pdf"]["sparse"]
    whole = open(f"{library}/B/big.pdf", "rb").read()
    assert got["B/big.pdf"]["sparse"] == "300000:" + hashlib.sha256(b"300000" + whole[: 64 * 1024] + whole[-64 * 1024 :]).hexdigest()[:16]


def test_files_stream_once(spark, library):
    top = fresh()
    os.makedirs(f"{top}/in/deep")

    def put(name, data=b"x"):
        with open(f"{top}/in/{name}", "wb") as f:
            f.write(data)

    def run():
        q = files.arriving(spark, f"{top}/in").writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["path"].rsplit("/", 1)[-1] for r in spark.read.parquet(f"{top}/out").collect())

    put("a.epub"), put("b.txt"), put("deep/c.PDF")
    assert run() == ["a.epub", "c.PDF"]
    put("d.mobi")
    assert run() == run() == ["a.epub", "c.PDF", "d.mobi"]


def test_missing_files(spark, library):
    rows_ = [(1, "A", "one", "EPUB"), (2, "A", "gone", "EPUB"), (3, None, "x", "PDF"), (4, "../B", "big", "PDF"), (5, "/etc", "big", "PDF"), (6, "B", "big", "PDF")]
    formats = spark.createDataFrame(rows_, "book_id long, path string, name string, format string")
    got = rows(files.missing(formats, files.listed(spark, library), library))
    assert got == [(2, "gone.epub", "FILE_MISSING_ON_DISK"), (3, "x.pdf", "NO_PATH_IN_DB"), (4, "big.pdf", "UNSAFE_BOOK_PATH"), (5, "big.pdf", "UNSAFE_BOOK_PATH")]
