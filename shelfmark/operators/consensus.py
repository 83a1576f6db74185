"""Candidate consensus (C1-C5): score each provider record and pick the best for each book.

Each step names its inputs once: normals, tokens, what is common and what is
left are columns of their own, so no edit distance stands in the plan twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`: the larger of N23 and N24 over two columns of N7 normals."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    df = df.withColumns({"_x": tokens(a), "_y": tokens(b)})
    df = df.withColumns({"_both": joined(F.array_intersect("_x", "_y")), "_p": joined(F.array_except("_x", "_y")), "_q": joined(F.array_except("_y", "_x"))})
    df = df.withColumns({"_one": F.trim(F.concat_ws(" ", "_both", "_p")), "_two": F.trim(F.concat_ws(" ", "_both", "_q"))})
    c = F.col
    part = lambda x: F.when(c("_both") != "", text.ratio(c("_both"), x)).otherwise(0.0)
    sets = F.when((c(a) == "") | (c(b) == ""), 0.0).otherwise(F.greatest(part(c("_one")), part(c("_two")), text.ratio(c("_one"), c("_two"))))
    return df.withColumn(out, F.when(c(a) == c(b), 1.0).otherwise(F.greatest(text.ratio(c(a), c(b)), sets))).drop("_x", "_y", "_both", "_p", "_q", "_one", "_two")


def thousandths(c: Column) -> Column:
    return F.rint(c * 1000) / 1000


def scored(books: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each book and candidate: conflict of valid ISBNs, tripwire, score (0 where tripped) in thousandths.

    The tripwire takes an unknown local author for half alike; the score takes the name as it stands. Of a candidate's authors, joined by
    `&`, the most similar one counts. `pos` tells a book's candidates apart.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = books.select("book_id", text.plain_key(F.col("title")).alias("t"), text.plain_key(F.col("author")).alias("a"), F.lower(given("author")).alias("raw"), isbn.canonical13(F.col("isbn")).alias("own13"), (given("isbn") != "").alias("has_isbn"))
    other = candidates.select("book_id", "pos", "provider", text.plain_key(F.col("title")).alias("ct"), F.split(given("author"), r"\s*&\s*").alias("names"), (given("author") != "").alias("has_author"), isbn.canonical13(F.col("isbn13")).alias("c13"), "is_hd_cover", "cover_url")
    both = with_similarity(other.join(own, "book_id"), "t", "ct", "title_sim").drop("t", "ct")
    each = with_similarity(both.withColumn("ca", F.explode("names")).withColumn("ca", text.plain_key(F.col("ca"))), "a", "ca", "alike").drop("names", "ca", "a")
    # rows lie by book since the join, so this aggregate shuffles nothing
    both = each.groupBy("book_id", "pos").agg(F.max("alike").alias("alike"), *[F.first(c).alias(c) for c in each.columns if c not in ("book_id", "pos", "alike")])
    local = F.col("raw") != ""
    both = both.withColumns({
        "trip_author": F.when(F.col("raw").isin("", "unknown"), 0.5).when(F.col("has_author"), F.col("alike")).otherwise(0.0),
        "author_score": F.when(~local, 0.5).when(F.col("has_author"), F.col("alike")).otherwise(0.0),
    })
    tripped = (F.col("title_sim") < 0.40) & (F.col("trip_author") < 0.35)
    same = F.when(F.coalesce(F.col("own13") == F.col("c13"), F.lit(False)), 1.0).otherwise(0.0)
    cover = F.when(F.col("is_hd_cover"), 1.0).when(F.coalesce("cover_url", F.lit("")) != "", 0.5).otherwise(0.0)
    penalty = F.when((F.col("author_score") < 0.25) & local, 0.35).otherwise(0.0)
    raw = F.when(F.col("has_isbn"), 0.35 * F.col("title_sim") + 0.25 * F.col("author_score") + 0.25 * same + 0.15 * cover).otherwise(0.5 * F.col("title_sim") + 0.35 * F.col("author_score") + 0.15 * cover) - penalty
    conflict = F.coalesce(F.col("own13") != F.col("c13"), F.lit(False))
    score = F.when(tripped, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), thousandths(raw))))
    return both.select("book_id", "pos", "provider", "c13", tripped.alias("tripped"), conflict.alias("conflict"), score.alias("score"))


def best(books: DataFrame, candidates: DataFrame) -> DataFrame:
    """The highest score, the first in provider order on ties, among candidates without an ISBN conflict.

    The local record stays where there are no such candidates or the best is tripped; the
    ISBNs that are put in quarantine are listed. Every outcome is tier C, as review evidence.
    """
    rows = scored(books, candidates)
    rank = F.struct((-F.col("score")).alias("s"), "pos")
    by = rows.groupBy("book_id").agg(
        F.min_by(F.when(~F.col("conflict"), F.struct("provider", "score", "tripped", "c13")), F.when(~F.col("conflict"), rank)).alias("top"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("conflict"), F.struct("pos", "c13")))), lambda x: x["c13"]), ",").alias("rejected"),
    )
    top = F.col("top")
    taken = F.coalesce(~top["tripped"], F.lit(False))
    reason = F.when(F.col("n").isNull(), "no_candidates").when(top.isNull(), "candidate_rejected_valid_isbn_conflict").when(top["tripped"], "tripwire").otherwise("best_candidate")
    held = F.when(F.col("n").isNotNull() & top.isNull(), F.col("rejected")).when(top["tripped"], F.coalesce(top["c13"], F.lit(""))).otherwise("")
    return books.select("book_id").join(by, "book_id", "left").select(
        "book_id", F.when(taken, top["provider"]).otherwise("local").alias("provider"), F.coalesce(top["score"], F.lit(0.0)).alias("score"),
        F.when(taken, "REVIEW_RECOMMENDED").otherwise("KEEP_LOCAL").alias("decision"), F.lit("C").alias("tier"), reason.alias("reason"), held.alias("quarantine"),
    )
