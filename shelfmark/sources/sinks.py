"""Sinks that may run twice (I3, I8, I9): what failed half-way is written again and stands there once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfmark.sources import records


class ConflictError(ValueError):
    """An id is stored with another payload."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a sink's table; none where nothing is written yet."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def upsert(path: str, new: DataFrame, key: str = "book_key", buckets: int = 64) -> None:
    """Rows replace those of equal key, the others stay; of rows with one key in `new`, that which is last in all columns.

    The table is partitioned by a hash of the key. Only partitions that `new` touches are read, merged and overwritten, each as a whole, so a run
    that ends half-way leaves old and new partitions, and the same run again makes all of them new.
    """
    spark = new.sparkSession
    columns = new.columns
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    latest = new.groupBy(key).agg(F.max(F.struct(*[c for c in columns if c != key])).alias("r")).select(key, "r.*").select(*columns).withColumn("bucket", bucket)
    schema = StructType([*new.schema.fields, StructField("bucket", IntegerType())])
    touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # `buckets` at most
    kept = stored(spark, path, schema).where(F.col("bucket").isin(*touched)).join(latest.select(key), key, "left_anti")
    merged = kept.select(*columns, "bucket").unionByName(latest)
    merged.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def insert_once(path: str, rows: DataFrame, schema: str = "evidence_id string, payload_sha256 string, book_id long") -> None:
    """I8: rows whose evidence_id isn't stored are appended, once each. An id with another payload, stored or in `rows`, is an error, and then nothing is written."""
    spark = rows.sparkSession
    have = stored(spark, path, schema)
    inside = rows.groupBy("evidence_id").agg(F.countDistinct("payload_sha256").alias("n")).where("n > 1")
    clash = inside.select("evidence_id").unionByName(records.conflicts(have, rows)).limit(3).collect()
    if clash:
        raise ConflictError(f"stored with another payload: {', '.join(sorted(r['evidence_id'] for r in clash))}")
    records.inserted(have, rows).write.mode("append").parquet(path)


def evidence_sink(path: str, schema: str = "evidence_id string, payload_sha256 string, book_id long") -> Callable[[DataFrame, int], None]:
    """I8 for `foreachBatch`: a batch writes a folder of its own, so a batch that runs again replaces what it wrote. Ids that other batches hold stay out; a conflict ends the stream."""

    def write(rows: DataFrame, batch: int) -> None:
        have = stored(rows.sparkSession, path, f"{schema}, batch long").where(F.col("batch") != batch)
        inside = rows.groupBy("evidence_id").agg(F.countDistinct("payload_sha256").alias("n")).where("n > 1").select("evidence_id")
        clash = inside.unionByName(records.conflicts(have, rows)).limit(3).collect()
        if clash:
            raise ConflictError(f"stored with another payload: {', '.join(sorted(r['evidence_id'] for r in clash))}")
        records.inserted(have, rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def write_report(path: str, run_id: str, verdicts: DataFrame) -> None:
    """A run's report, one JSON line a book in a folder of the run, whole or not at all: {run_id, book_id, verdicts[{field, verdict, confidence}]}. Running again replaces it."""
    line = records.report(verdicts).select(F.to_json(F.struct(F.lit(run_id).alias("run_id"), "book_id", F.from_json("verdicts", "array<struct<field string, verdict string, confidence long>>").alias("verdicts"))).alias("value"))
    line.write.mode("overwrite").text(f"{path}/run={run_id}")
