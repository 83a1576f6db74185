"""Rules held in tables (N29), merged identifiers (R9), and text functions for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text

#: Rules that may reach every task at most.
RULES = 10_000


def periodical_rules(spark: SparkSession) -> DataFrame:
    """The periodicals as a table of rules: place, pattern, author, sort, rating, tags."""
    return spark.createDataFrame([(i, *r[:4], list(r[4])) for i, r in enumerate(text.PERIODICALS)], "place int, pattern string, author string, sort string, rating int, tags array<string>")


def periodicals(books: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule whose pattern a book's title meets, in any case; else, for books whose author is none, the first whose author the title holds.

    `books`: book_id, title, author; `rules`: as `periodical_rules`, of `RULES` rows at most, since each task gets them. A join by pattern.
    """
    if len(rules.select("place").take(RULES + 1)) > RULES:
        raise ValueError(f"more than {RULES} rules")
    r = F.broadcast(rules.select("place", F.concat(F.lit("(?iU)"), "pattern").alias("pattern"), F.col("author").alias("rule_author"), "sort", "rating", "tags"))
    meets = F.expr("title rlike pattern")
    named = F.lower("author").isin("calibre", "unknown") & F.contains(F.lower("title"), F.lower("rule_author"))
    found = books.where("title <> ''").select("book_id", "title", "author").join(r, meets | named)
    first = found.groupBy("book_id").agg(F.min_by(F.struct("rule_author", "sort", "rating", "tags"), F.struct((~meets).alias("by_name"), "place")).alias("r"))
    return first.select("book_id", F.col("r.rule_author").alias("author"), "r.sort", "r.rating", "r.tags")


def normal_identifiers(ids: Column) -> Column:
    """Namespaces and values trimmed, namespaces in lower case; an ISBN that isn't valid goes, as do empty parts. Of equal namespaces the last stays."""
    entry = F.transform(F.map_entries(ids), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value")))
    sound = F.transform(entry, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "isbn", isbn.canonical13(e["value"])).otherwise(F.nullif(e["value"], F.lit(""))).alias("value")))
    kept = F.filter(sound, lambda e: e["value"].isNotNull() & (e["key"] != ""))
    return F.map_from_entries(F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x["key"] == e["key"])))


def merged_identifiers(current: Column, resolved: Column) -> Column:
    """The record's identifiers with those that evidence names in their place; unobserved namespaces stay. A null map is an empty one."""
    none = F.create_map().cast("map<string,string>")
    old, new = (normal_identifiers(F.coalesce(c, none)) for c in (current, resolved))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def identifier_patches(decided: DataFrame, current: DataFrame) -> DataFrame:
    """What a book's identifiers become where evidence decides them: book_id, target, changed.

    `decided`: book_id, ids (map) of books whose consensus may be written; `current`: book_id, ids (map).
    """
    both = decided.select("book_id", F.col("ids").alias("new")).join(current.select("book_id", F.col("ids").alias("old")), "book_id", "left")
    key = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    out = both.withColumn("target", merged_identifiers(F.col("old"), F.col("new")))
    return out.select("book_id", "target", (key(F.col("target")) != key(normal_identifiers(F.coalesce("old", F.create_map().cast("map<string,string>"))))).alias("changed"))


def sql_functions(spark: SparkSession) -> None:
    """`title_sort(t)` and `author_sort(a)` (N21, N15) for query texts. They are the very Column expressions, so Catalyst sees through them."""
    for name, of in (("title_sort", text.title_sort), ("author_sort", text.author_sort)):
        plan = spark.createDataFrame([], "v string").select(of(F.col("v")).alias("out"))._jdf.queryExecution().analyzed()
        body = plan.expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")
