"""Catalogue profile, runs, ledger and calibration reports: one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import isbn

#: The steps that an operation may take.
STEPS = {
    "requested": ("claimed", "cancelled"), "claimed": ("requested", "writing", "failed", "cancelled"), "writing": ("verifying", "restoring", "unknown"),
    "verifying": ("succeeded", "restoring", "unknown"), "restoring": ("restored", "restore_failed"),
}
STATES = ("requested", "claimed", "writing", "verifying", "restoring", "succeeded", "restored", "restore_failed", "unknown", "failed", "cancelled")


def inventory(books: DataFrame, formats: DataFrame) -> DataFrame:
    """Q1: counts of books, formats, ISBN states and blanks in one row."""
    per = formats.groupBy("book_id").agg(F.count("*").alias("n"))
    state = isbn.state(F.col("isbn"))
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    at = F.col("last_modified").try_cast("timestamp_ntz")
    return books.join(per, "book_id", "left").agg(
        F.count("*").alias("books"), F.sum(F.coalesce("n", F.lit(0))).alias("formats"), F.count_if(F.col("n") > 1).alias("multi_format"), F.count_if(F.col("n").isNull()).alias("no_format"),
        *[F.count_if(state == s).alias(f"isbn_{s}") for s in ("missing", "valid", "invalid")], blank("title").alias("blank_title"), blank("author").alias("blank_author"), blank("language").alias("blank_language"),
        blank("publisher").alias("blank_publisher"), blank("pubdate").alias("blank_pubdate"), F.min(at).cast("string").alias("modified_min"), F.max(at).cast("string").alias("modified_max"),
        blank("last_modified").alias("modified_missing"), F.count_if((F.coalesce(F.trim("last_modified"), F.lit("")) != "") & at.isNull()).alias("modified_invalid"),
    )


def by_value(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def without_formats(books: DataFrame, formats: DataFrame) -> DataFrame:
    """Q6: books that no format row names."""
    return books.join(formats, "book_id", "left_anti").select("book_id")


def cover_classes(covers: DataFrame) -> DataFrame:
    """Q8: tiny and huge covers by size."""
    kind = (
        F.when(F.col("size_bytes") < 4000, "tiny").when((F.col("width").cast("long") * F.col("height") > 30000000) | (F.col("size_bytes") > 15000000), "huge")
        .when((F.col("width") < 200) | (F.col("height") < 250), "tiny").otherwise("fine")
    )
    return covers.select("cover_id", kind.alias("size_class"))


def requests_profile(requests: DataFrame) -> DataFrame:
    """Q17: count and mean duration by route and status."""
    return requests.groupBy("route", "status").agg(F.count("*").alias("n"), F.round(F.avg("duration_s"), 6).alias("mean_s"))


def calibration_report(rows: DataFrame) -> DataFrame:
    """K1: counts of a labelled corpus in one row."""
    return rows.agg(
        F.count("*").alias("sample_size"), F.count_if(F.col("tier") == "A").alias("tier_a"), F.count_if((F.col("tier") == "A") & ~F.col("identity_correct")).alias("false_positives"),
        F.count_if(F.col("would_auto_apply") & (~F.col("identity_correct") | ~F.col("patch_correct"))).alias("false_auto_applies"), F.count("review_seconds").alias("timed"),
        F.bround(F.sum("review_seconds"), 3).alias("review_seconds"), F.sum("egress_bytes").alias("egress_bytes"),
    )


def repeated_ids(rows: DataFrame, column: str) -> DataFrame:
    """K2: ids that stand more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def sealed_report(report: DataFrame) -> DataFrame:
    """K4: the report with `seal`, SHA-256 over its columns in order."""
    return report.withColumn("seal", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in report.columns]), 256))


def full_gate(report: DataFrame, now: str, evaluated: str, expires: str, policy: str = "manifestation-v2", enabled: bool = True, days: int = 30) -> DataFrame:
    """K3 in whole: switch and seal decide alone; then version, thresholds, and the report's age. `report` has seal and policy."""
    body = [c for c in report.columns if c not in ("seal", "policy")]
    again = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in body]), 256)
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    reasons = F.array_compact(F.array(
        F.when(F.col("policy") != policy, F.lit("policy_version")), F.when(F.col("sample_size") < 100, F.lit("sample_too_small")), F.when(F.col("tier_a") < 50, F.lit("tier_a_too_small")),
        F.when(F.col("false_auto_applies") != 0, F.lit("false_auto_applies")), F.when(F.col("false_positives") / F.greatest("tier_a", F.lit(1)) > 0, F.lit("false_positive_rate")),
        F.when(t(evaluated) > t(now), F.lit("in_the_future")), F.when(t(expires) <= t(now), F.lit("expired")), F.when(t(now) - t(evaluated) > F.make_dt_interval(days=F.lit(days)), F.lit("too_old")),
    ))
    first = F.when(~F.lit(enabled), F.array(F.lit("disabled"))).when(~F.col("seal").eqNullSafe(again), F.array(F.lit("seal_invalid"))).otherwise(reasons)
    return report.select(F.array_join(first, ",").alias("reasons"), (F.size(first) == 0).alias("open"))


def gate(report: DataFrame) -> DataFrame:
    """K3: the reasons that fail the gate."""
    reasons = F.array_compact(F.array(
        F.when(F.col("sample_size") < 100, F.lit("sample_too_small")), F.when(F.col("tier_a") < 50, F.lit("tier_a_too_small")),
        F.when(F.col("false_auto_applies") != 0, F.lit("false_auto_applies")), F.when(F.col("false_positives") / F.greatest("tier_a", F.lit(1)) > 0, F.lit("false_positive_rate")),
    ))
    return report.select(F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("open"))


def illegal_steps(operations: DataFrame) -> DataFrame:
    """Steps of a book's operations, in order of time, that the table of steps doesn't hold."""
    w = Window.partitionBy("book_key").orderBy("created_at", "operation_id")
    legal = F.lit(False)
    for a, to in STEPS.items():
        legal = legal | ((F.col("before") == a) & F.col("state").isin(*to))
    return operations.withColumn("before", F.lag("state").over(w)).where(F.col("before").isNotNull() & ~legal).select("operation_id", "before", "state")


def first_requests(operations: DataFrame) -> DataFrame:
    """The first operation of each key."""
    w = Window.partitionBy("idempotency_key").orderBy("created_at", "operation_id")
    return operations.withColumn("n", F.row_number().over(w)).where("n = 1").select("idempotency_key", "operation_id", "state")


def claimable(runs: DataFrame, now: str) -> DataFrame:
    """L4: runs that aren't finished and whose lease is free or over."""
    return runs.where(F.col("finished_at").isNull() & (F.col("lease_owner").isNull() | (F.col("lease_expires_at") < F.lit(now).cast("timestamp_ntz")))).select("run_id", "status")


def progress(runs: DataFrame) -> DataFrame:
    """L1: percent done over all runs, 100 if there are none."""
    done = F.count_if(F.col("status").isin("completed", "failed", "skipped"))
    return runs.agg(F.count("*").alias("total"), done.alias("done"), F.when(F.count("*") == 0, F.lit(100.0)).otherwise(F.round(100 * done / F.count("*"), 6)).alias("percent"))
