"""Catalogue audit (Q2-Q7, Q9-Q16, Q18): joins and aggregates over the library's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of bad titles, tried in this order.
BAD_TITLES = (r"\[welib\.org\]", r"\(z-library\)", "_print", "untitled", "microsoft word", r"v\d+\.\d+")
#: States of books that ask for attention, and how many are listed at most.
PROBLEMS = ("needs_review", "suggest_fix", "defer")
MOST_LISTED = 500


def manifest_hash(books: DataFrame, formats: DataFrame, bucket: int = 4096, levels: int = 3) -> DataFrame:
    """Q2: one SHA-256 over all books in order of id, as a tree: `bucket` books or hashes at a time, so that no list grows with the table."""
    held = formats.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"))
    row = F.sha2(F.concat_ws("|", F.col("book_id").cast("string"), F.coalesce("formats", F.lit("")), F.coalesce("last_modified", F.lit(""))), 256)
    at = books.join(held, "book_id", "left").select(F.col("book_id").alias("k"), row.alias("h"))
    for _ in range(levels):
        by = at.groupBy(F.floor(F.col("k") / bucket).alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("hs"))
        at = by.select("k", F.sha2(F.array_join("hs.h", ""), 256).alias("h"))
    return at.select(F.col("k").alias("part"), F.col("h").alias("manifest"))


def orphans(books: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """Q3: how many rows of each link table name a book that isn't there."""
    each = [df.select("book_id").join(books.select("book_id"), "book_id", "left_anti").select(F.lit(name).alias("link")) for name, df in links.items()]
    return reduce(DataFrame.unionByName, each).groupBy("link").agg(F.count("*").alias("n_orphans"))


def ratings(books: DataFrame, rated: DataFrame) -> DataFrame:
    """Q4: books by rating, in stars of half the value; unrated books apart."""
    none = books.select("book_id").join(rated, "book_id", "left_anti").select(F.lit("unrated").alias("stars"))
    return rated.select(F.format_string("%.1f", F.col("rating") / 2).alias("stars")).unionByName(none).groupBy("stars").agg(F.count("*").alias("n"))


def sort_desyncs(books: DataFrame, links: DataFrame) -> DataFrame:
    """Q5: books whose stored author sort is null or not that of their authors in order of link."""
    made = links.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "sort"))), lambda x: x["sort"]), " & ").alias("canonical"))
    return books.select("book_id", "author_sort").join(made, "book_id", "left").where(F.col("author_sort").isNull() | (F.col("author_sort") != F.col("canonical")))


def missing_files(formats: DataFrame, listing: DataFrame) -> DataFrame:
    """Q6: declared files that a listing doesn't show."""
    return formats.select("book_id", "format").join(listing, ["book_id", "format"], "left_anti")


def bad_titles(books: DataFrame) -> DataFrame:
    """Q7: the first pattern that a title meets, or that it ends as a file name."""
    out = F.when(F.lower("title").rlike(r"\.(pdf|epub|mobi|azw3)$"), "ends_with_extension")
    for p in reversed(BAD_TITLES):
        out = F.when(F.col("title").rlike(f"(?i){p}"), p).otherwise(out)
    return books.select("book_id", "title", out.alias("pattern")).where("pattern is not null")


def summary(parts: dict[str, DataFrame], sample: int = 10) -> DataFrame:
    """Q9: for each finding its count and its first `sample` ids."""
    each = []
    for name, df in parts.items():
        few = df.select("book_id").orderBy("book_id").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("book_id")).cast("array<string>"), ",").alias("first_ids"))
        each.append(df.agg(F.count("*").alias("n")).crossJoin(few).select(F.lit(name).alias("finding"), "n", "first_ids"))  # one row each
    return reduce(DataFrame.unionByName, each)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Q10: a page of a listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Q11: the newest row of each key."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def problematic(books: DataFrame, packages: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """Q12: books whose status asks for attention, or is `status`, with the flags of their newest evidence package; the smallest keys, at most `MOST_LISTED`.

    `books`: book_key, status and what is to be shown; `packages`: book_key, created_at, evidence_id, flags.
    """
    asked = books.where(F.col("status") == status) if status else books.where(F.col("status").isin(*PROBLEMS))
    few = asked.orderBy("book_key").limit(max(1, min(limit, MOST_LISTED)))
    newest = packages.groupBy("book_key").agg(F.max_by("flags", F.struct("created_at", "evidence_id")).alias("flags"))
    return few.join(newest, "book_key", "left").withColumn("flags", F.coalesce("flags", F.lit("")))


def run_metrics(books: DataFrame, runs: DataFrame, run_id: str | None = None, sample: int = 5) -> DataFrame:
    """Q14: books of a run, the newest if none is named, by status, with the total and the run's `sample` smallest keys. `books`: book_key, run_id, status; `runs`: run_id, created_at."""
    run = runs.where(F.col("run_id") == run_id).select("run_id") if run_id else runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("run_id")
    own = books.join(F.broadcast(run.limit(1)), "run_id")  # one row
    few = own.select("book_key").orderBy("book_key").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("book_key")).cast("array<string>"), ",").alias("sample_keys"))
    by = own.groupBy("run_id", "status").agg(F.count("*").alias("n"))
    return by.crossJoin(own.agg(F.count("*").alias("total"))).crossJoin(few).select("run_id", "status", "n", "total", "sample_keys")  # one row each


def action_shares(rolled: DataFrame) -> DataFrame:
    """Q15: books by action, and by flag, with the share that is eligible."""
    one = rolled.select(F.explode(F.filter(F.concat(F.array(F.concat(F.lit("action:"), "action")), F.transform(F.split("flags", ","), lambda x: F.when(x != "", F.concat(F.lit("flag:"), x)))), lambda x: x.isNotNull())).alias("what"), "eligible")
    return one.groupBy("what").agg(F.count("*").alias("n"), F.round(F.avg(F.col("eligible").cast("int")), 6).alias("eligible_share"))


def metrics(events: DataFrame) -> DataFrame:
    """Q16: sum, count and last value of each name and label set. `events`: name, labels (a sorted string), ts, event_id, value."""
    return events.groupBy("name", "labels").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


def review_deck(covers: DataFrame, after: int, limit: int) -> DataFrame:
    """Q18: the next `limit` covers after a key that need work or score under 60."""
    return covers.where((F.col("cover_id") > after) & (F.col("actionable") | (F.col("cqs") < 60))).orderBy("cover_id").limit(limit)
