"""Runs, ledger and retention (L2, L3, L5, L7, L11-L16) as joins over state tables; times are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in which an audited book rests, and states in flight.
RESTING = ("shadowed", "verified", "review", "deferred", "failed", "source_changed", "blocked_recovery")
IN_FLIGHT = ("snapshotting", "extracting", "resolving", "decided", "applying")
#: Fields that a write may change by itself.
VOLATILE = ("last_modified", "timestamp")


def resumable(keys: DataFrame, results: DataFrame) -> DataFrame:
    """L2: keys without a sealed result that succeeded; failed ones are tried again."""
    return keys.join(results.where(F.col("valid_seal") & (F.col("state") == "succeeded")).select("book_key"), "book_key", "left_anti")


def membership(stored: DataFrame, frozen: DataFrame) -> DataFrame:
    """L3: keys that only one of two snapshots has; no rows where they are equal."""
    both = stored.select("book_key", F.lit(1).alias("s")).unionByName(frozen.select("book_key", F.lit(2).alias("s"))).groupBy("book_key").agg(F.count_if(F.col("s") == 1).alias("stored"), F.count_if(F.col("s") == 2).alias("frozen"))
    return both.where("stored <> frozen")


def reset_stale(results: DataFrame) -> DataFrame:
    """Results that don't rest go back to pending, whatever state they name; `reset` tells which did. `results`: result_id, state, evidence_id."""
    rests = F.col("state").isin(*RESTING)
    stale = F.coalesce(F.col("state").isin(*IN_FLIGHT) | ~rests & (F.col("state") != "pending"), F.lit(True))
    return results.select("result_id", F.when(stale, "pending").otherwise(F.col("state")).alias("state"), stale.alias("reset"), (rests & F.col("evidence_id").isNotNull()).alias("sealed"))


def acknowledged(operations: DataFrame, acknowledgements: DataFrame, pilots: DataFrame, outbox: DataFrame, locks: DataFrame, current: str) -> DataFrame:
    """Ids of failed operations whose incident is settled: acknowledged, completed, of a stopped pilot that isn't the `current` one, with a failed outbox row, and no lock on their book."""
    old = pilots.where((F.col("state") == "stopped") & (F.col("pilot_id") != current)).select("pilot_id")
    failed = outbox.where("status = 'failed'").select(F.col("aggregate_id").alias("operation_id"))
    rows = operations.where("state = 'failed' and completed_at is not null").join(acknowledgements.select("operation_id"), "operation_id", "left_semi")
    return rows.join(old, "pilot_id", "left_semi").join(failed, "operation_id", "left_semi").join(locks.select("book_key"), "book_key", "left_anti").select("operation_id")


def open_depth(operations: DataFrame, settled: DataFrame, policy: str = "manifestation-v2") -> DataFrame:
    """Operations of a policy by state, without those in `settled`."""
    return operations.where(F.col("policy_version") == policy).join(settled, "operation_id", "left_anti").groupBy("state").agg(F.count("*").alias("n"))


#: The states that a listing of depths always shows, by kind.
DEPTHS = {
    "outbox": ("pending", "processing", "failed", "published"), "operations": ("unknown", "restore_failed"),
    "v2_operations": ("requested", "claimed", "writing", "verifying", "restoring", "succeeded", "restored", "restore_failed", "unknown", "failed", "cancelled"), "changes": ("failed_rollback_failed",), "pilots": ("open", "stopped", "completed"),
}


def depths(outbox: DataFrame, operations: DataFrame, changes: DataFrame, pilots: DataFrame, open_operations: DataFrame, settled: DataFrame) -> DataFrame:
    """Counts by kind and state, for pilots the reserved and the greatest number of operations; states that are absent count 0, others that occur are shown too.

    `open_operations`: what `open_depth` gives; `settled`: acknowledgements, counted as one row.
    """
    spark = outbox.sparkSession
    count = lambda df, kind, state: df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "state", "n", F.lit(None).cast("long").alias("most"))
    known = spark.createDataFrame([(k, s) for k, ss in DEPTHS.items() for s in ss], "kind string, state string")
    held = pilots.groupBy("state").agg(F.sum("reserved").alias("n"), F.sum("maximum").alias("most")).select(F.lit("pilots").alias("kind"), "state", "n", "most")
    v2 = open_operations.select(F.lit("v2_operations").alias("kind"), "state", "n", F.lit(None).cast("long").alias("most"))
    told = count(outbox, "outbox", "status").unionByName(count(operations, "operations", "state")).unionByName(v2).unionByName(count(changes, "changes", "status")).unionByName(held)
    told = told.unionByName(settled.agg(F.count("*").alias("n")).select(F.lit("incidents").alias("kind"), F.lit("acknowledged").alias("state"), "n", F.lit(None).cast("long").alias("most")))
    zero = F.when(F.col("kind") == "pilots", F.lit(0))
    return known.join(told, ["kind", "state"], "full_outer").select("kind", "state", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("most", zero).cast("long").alias("most"))


#: States of runs that are shown, and those that are active.
RUN_STATES = ("pending", "inventorying", "running", "cancelling", "cancelled", "completed", "completed_with_errors", "failed", "source_changed", "blocked_recovery")
ACTIVE = ("pending", "inventorying", "running", "cancelling")


def run_depth(runs: DataFrame, now: Column, contract: str = "certificate-a-v1", pipeline: str = "manifestation-v2") -> DataFrame:
    """Runs of one contract and pipeline by known state, absent ones 0, with the oldest sign of life over all active runs and its age in seconds, 0 if there is none."""
    own = runs.where((F.col("contract_version") == contract) & (F.col("pipeline_version") == pipeline))
    oldest = own.where(F.col("status").isin(*ACTIVE)).agg(F.min(F.coalesce("heartbeat_at", "started_at")).alias("oldest"))
    counts = own.groupBy("status").agg(F.count("*").alias("n"))
    known = runs.sparkSession.createDataFrame([(s,) for s in RUN_STATES], "status string")
    age = F.coalesce(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp")), F.lit(0))
    return known.join(counts, "status", "left").crossJoin(F.broadcast(oldest)).select("status", F.coalesce("n", F.lit(0)).alias("n"), F.col("oldest").cast("string").alias("oldest_active"), age.alias("age_s"))  # one row


BOUND = ["book_id", "run_id", "package_hash", "patch_hash"]


def authorization(approvals: DataFrame) -> DataFrame:
    """The newest authorization of each book, run, package and patch."""
    return approvals.groupBy(*BOUND).agg(F.max_by("authorization_id", F.struct("created_at", "authorization_id")).alias("authorization_id"))


def approvals(rolled: DataFrame, locks: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Suggested fixes, queued where the gate or an authorization of the same run, package and patch lets them and a patch is left without locked fields, else skipped.

    `rolled` has run_id and package_hash; a book without a package hash has no authorization. `locks`: book_id, field; a book has few fields, so its locks are one small list.
    """
    held = locks.groupBy("book_id").agg(F.collect_set("field").alias("held"))
    rows = rolled.where("action = 'suggest_fix'").join(held, "book_id", "left")
    free = F.array_except(F.split("patch", ","), F.coalesce("held", F.array().cast("array<string>")))
    rows = rows.withColumn("patch", F.array_join(F.array_sort(F.filter(free, lambda x: x != "")), ",")).withColumn("patch_hash", F.sha2("patch", 256))
    told = rows.join(authorization(authorizations), BOUND, "left")
    may = (F.col("gate") == "ok") | F.col("authorization_id").isNotNull()
    return told.select("book_id", "patch", "authorization_id", F.when((F.col("patch") != "") & may, "queued").otherwise("skipped").alias("outcome"))


def expired(points: DataFrame, now: Column, days: int) -> DataFrame:
    """Restore points that are older than their time to live."""
    return points.where(F.col("created_at") + F.make_dt_interval(days=F.lit(days)) < now)


def fresh(beats: DataFrame, now: Column, seconds: int, bound: dict[str, str]) -> DataFrame:
    """Whether each heartbeat is at most `seconds` old and bound to what it should be."""
    right = F.lit(True)
    for column, value in bound.items():
        right = right & F.col(column).eqNullSafe(F.lit(value))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("beat_at").cast("timestamp"))
    return beats.select("owner", F.coalesce(right & (age >= 0) & (age <= seconds * 1_000_000), F.lit(False)).alias("fresh"))


def retained(jobs: DataFrame, now: Column, hours: int = 1, most: int = 100) -> DataFrame:
    """All jobs but finished ones older than `hours`; where more than `most` are left, the oldest finished ones go until `most` are, or none is finished. Finished jobs without a time are the oldest."""
    done = F.col("status").isin("completed", "failed")
    young = jobs.where(done & F.coalesce(F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True)))
    room = max(0, most - jobs.where(~done).count())
    return jobs.where(~done).unionByName(young.orderBy(F.desc_nulls_last("updated_at"), F.desc("job_id")).limit(room))


def read_back(patches: DataFrame, observed: DataFrame) -> DataFrame:
    """By book whether every patched field, but volatile ones, reads back as patched. Both: book_id, field, value.

    An edition may be read back under `#edition`, which comes first unless it is empty, and null is as good as empty there; a cover by the hash of its file, as `cover_sha256`.
    """
    kept = patches.where(~F.col("field").isin(*VOLATILE))
    alias = F.when(F.col("field") == "#edition", "edition_statement").when(F.col("field") == "cover_sha256", "cover").otherwise(F.col("field"))
    own = observed.where(F.col("field") != "cover").select("book_id", alias.alias("field"), F.col("value").alias("seen"), (F.col("field") != "#edition").alias("late"))
    first = own.where((F.col("field") != "edition_statement") | (F.coalesce("seen", F.lit("")) != "")).groupBy("book_id", "field").agg(F.min_by("seen", "late").alias("seen"))
    both = kept.join(first, ["book_id", "field"], "left")
    text = lambda c: F.when(F.col("field") == "edition_statement", F.coalesce(c, F.lit(""))).otherwise(F.col(c))
    same = text("value").eqNullSafe(text("seen"))
    return both.groupBy("book_id").agg(F.min(same).alias("matches"), F.count_if(~same).alias("n_differ"))
