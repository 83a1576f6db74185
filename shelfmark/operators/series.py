"""Gaps in the volumes of a series (G1-G3). Spans are tested on aggregates before any list or range is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200
MOST_INNER = 1000


def _whole() -> Column:
    return F.col("i") == F.floor("i")


def _missing(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """series and the ascending numbers from `start` to `top` that it doesn't own. A number is a row until it is known to be missing."""
    want = spans.select("series", F.explode(F.sequence("start", "top")).alias("v"))
    return want.join(owned, ["series", "v"], "left_anti").groupBy("series").agg(F.array_sort(F.collect_list("v")).alias("missing"))


def _listed(rows: DataFrame, spans: DataFrame, value: Column, name: str) -> DataFrame:
    """Distinct values of the series that passed, in order."""
    return rows.join(spans.select("series"), "series", "left_semi").select("series", value.alias("x")).distinct().groupBy("series").agg(F.array_sort(F.collect_list("x")).alias(name))


def full_gaps(books: DataFrame, min_owned: int = 1, most: int = MOST) -> DataFrame:
    """G1: volumes missing from 1 to the largest whole number owned, with the numbers owned and the authors in order of name; 0 and null count as 1.

    `books`: book_id, series, series_index, author. A series wider than `most` between its whole numbers is left out, as is one that owns volume 1 alone.
    """
    index = F.when(F.coalesce("series_index", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("series_index")).cast("double")
    rows = books.where("series is not null").select("series", "author", index.alias("i"))
    whole = F.when(_whole() & (F.col("i") >= 1), F.col("i").cast("int"))
    by = rows.groupBy("series").agg(F.count("*").alias("total_owned"), F.min(whole).alias("least"), F.max(whole).alias("top"))
    spans = by.where((F.col("total_owned") >= min_owned) & F.col("top").isNotNull() & (F.col("top") > 1) & (F.col("top") - F.col("least") <= most)).withColumn("start", F.lit(1))
    missing = _missing(spans, rows.select("series", whole.alias("v")).where("v is not null").distinct())
    names = _listed(rows.select("series", F.explode(F.split("author", " & ")).alias("a")).where(F.trim("a") != ""), missing, F.trim("a"), "names")
    out = spans.join(missing, "series").join(_listed(rows, missing, F.col("i"), "owned"), "series").join(names, "series", "left")
    return out.select("series", F.coalesce(F.array_join("names", " & "), F.lit("Unknown")).alias("authors"), "total_owned", "owned", "missing")


def topology(books: DataFrame, most: int = MOST_INNER) -> DataFrame:
    """Volumes missing between the smallest and the largest owned, and before the smallest if that is from 2 to 5; the volumes between whole numbers; and a sentence on both.

    Authors are those of the first volume that has any. `books` as in G1; null indices count as 1, ones that are no numbers are left out.
    """
    rows = books.where("series is not null").select("series", "book_id", "author", F.coalesce(F.col("series_index").cast("double"), F.lit(1.0)).alias("i"))
    rows = rows.where(~F.isnan("i") & (F.abs("i") != float("inf")))
    whole = F.when(_whole(), F.col("i").cast("int"))
    named = F.when(F.col("author") != "", F.struct("i", "book_id"))
    by = rows.groupBy("series").agg(F.min(whole).alias("least"), F.max(whole).alias("top"), F.coalesce(F.min_by("author", named), F.lit("")).alias("authors"))
    spans = by.where(F.col("top") - F.col("least") <= most).withColumn("start", F.when(F.col("least").between(2, 5), F.lit(1)).otherwise(F.col("least")))
    missing = _missing(spans, rows.select("series", whole.alias("v")).where("v is not null").distinct())
    between = _listed(rows.where(~_whole()), missing, F.col("i"), "fractional")
    out = spans.join(missing, "series").join(between, "series", "left").withColumn("fractional", F.coalesce("fractional", F.array().cast("array<double>")))
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    aside = F.when(F.size("fractional") > 0, F.concat(F.lit(" (Contains side novellas: "), said("fractional"), F.lit(")"))).otherwise("")
    return out.select("series", "authors", "missing", "fractional", F.concat(F.lit("Missing volumes: "), said("missing"), aside).alias("summary"))


def wishlist(books: DataFrame) -> DataFrame:
    """A row for each missing volume, with the text to search for."""
    each = full_gaps(books).select("series", "authors", F.explode("missing").alias("volume"))
    return each.select("series", "volume", "authors", F.concat("series", F.lit(" #"), F.col("volume").cast("string"), F.lit(" "), "authors").alias("query"))
