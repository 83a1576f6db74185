"""Duplicate and linkage operators (D2-D8): blocking by key, then one aggregation per block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text
from shelfmark.operators.graph import components


def _clusters(keyed: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """Of each block of two books or more: its smallest id, number of books, a sum of hashes that stands for the set of members, and whether no format is there twice.

    `keyed`: book_id and the keys, once a book. Counts and sums are partial before a key's rows meet, so a block of any size is one row.
    """
    by = keyed.groupBy(*keys).agg(F.count("*").alias("n_books"), F.min("book_id").alias("cluster_id"), F.sum(F.xxhash64("book_id").cast("decimal(38,0)")).alias("members")).where("n_books > 1")
    held = keyed.join(formats.select("book_id", "format").distinct(), "book_id").groupBy(*keys, "format").agg(F.count("*").alias("n"))
    held = held.groupBy(*keys).agg(F.sum("n").alias("n_formats"), F.count("*").alias("n_distinct"))
    mergeable = F.coalesce(F.col("n_formats") == F.col("n_distinct"), F.lit(False))
    return by.join(held, keys, "left").withColumn("mergeable", mergeable).drop("n_formats", "n_distinct")


def _members(keyed: DataFrame, clusters: DataFrame, keys: list[str], sure: float, unsure: float) -> DataFrame:
    """A row for each book of each cluster."""
    action = F.when(F.col("mergeable"), "MERGE_FORMATS").otherwise("INSPECT")
    confidence = F.when(F.col("mergeable"), F.lit(sure)).otherwise(F.lit(unsure))
    return keyed.join(clusters, keys).select(*keys, "cluster_id", "book_id", "n_books", action.alias("action"), confidence.alias("confidence"))


def _titled(books: DataFrame) -> DataFrame:
    return books.select("book_id", text.duplicate_key(F.col("title")).alias("title_key"), text.duplicate_key(F.col("author")).alias("author_key")).where("title_key <> ''")


def title_author_clusters(books: DataFrame, formats: DataFrame) -> DataFrame:
    """Books of equal title and author keys, a row each, with the smallest id of their cluster; merge where no format stands twice, else inspect. Books without a title key stay out."""
    keys = ["title_key", "author_key"]
    keyed = _titled(books)
    return _members(keyed, _clusters(keyed, formats, keys), keys, 0.98, 0.85)


def isbn_clusters(books: DataFrame, formats: DataFrame) -> DataFrame:
    """D3: books of equal plausible ISBNs, except member sets that D2 has: those of equal smallest id, size and sum of member hashes."""
    keyed = books.where(isbn.plausible(F.col("isbn"))).select("book_id", isbn.cleaned(F.col("isbn")).alias("isbn"))
    known = _clusters(_titled(books), formats, ["title_key", "author_key"]).select("cluster_id", "n_books", "members")
    found = _clusters(keyed, formats, ["isbn"]).join(known, ["cluster_id", "n_books", "members"], "left_anti")
    return _members(keyed, found, ["isbn"], 0.99, 0.88)


def work_components(books: DataFrame) -> DataFrame:
    """Components over equal canonical ISBNs and equal author and title; one row for each book of a cluster of several.

    A block is a star around its smallest id, so a block of n books gives n - 1 edges.
    """
    keyed = books.select("book_id", isbn.canonical13(F.col("isbn")).alias("isbn"), F.coalesce(text.clean_author(F.col("author")), F.lit("")).alias("author"), F.lower(F.trim("title")).alias("title"))
    blocks = keyed.where("isbn is not null").select("book_id", F.concat(F.lit("i:"), "isbn").alias("block")).unionByName(
        keyed.where("title is not null and title <> ''").select("book_id", F.concat(F.lit("t:"), F.lower("author"), F.lit("\n"), "title").alias("block"))
    )
    centre = blocks.groupBy("block").agg(F.min("book_id").alias("centre"))
    edges = blocks.join(centre, "block").where("book_id <> centre").select(F.col("book_id").alias("x"), F.col("centre").alias("y")).distinct()
    others = components(edges).select(F.col("id").alias("book_id"), F.col("component").alias("cluster_id"))
    return others.unionByName(others.select(F.col("cluster_id").alias("book_id"), "cluster_id").distinct()).distinct()


def work_clusters(books: DataFrame, formats: DataFrame) -> DataFrame:
    """Class, confidence and canonical book of each cluster; members are in `work_components`.

    CLONE where every member has the same complete map of formats to 64-digit hashes, MULTIFORMAT where two members share
    no format and have EPUB and PDF, else EDITION. Canonical: the first member with EPUB, else the first.
    """
    members = work_components(books)
    hashed = F.lower(F.trim("digest")).rlike("^[0-9a-f]{64}$")
    maps = formats.groupBy("book_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", F.upper(F.trim("format")), F.lower(F.trim("digest"))))), ";"), 256).alias("map"),
        (F.coalesce(F.min(hashed), F.lit(False)) & (F.count("*") == F.countDistinct(F.upper(F.trim("format"))))).alias("whole"), F.max(F.col("format") == "EPUB").alias("epub"), F.max(F.col("format") == "PDF").alias("pdf"),
    )
    formats_of = members.join(formats.select("book_id", "format"), "book_id").groupBy("cluster_id").agg(F.count("*").alias("n_formats"), F.countDistinct("format").alias("n_distinct"))
    by = members.join(maps, "book_id", "left").groupBy("cluster_id").agg(
        F.count("*").alias("n_books"), F.min(F.coalesce("whole", F.lit(False))).alias("whole"), F.countDistinct("map").alias("n_maps"), F.coalesce(F.max("epub"), F.lit(False)).alias("epub"), F.coalesce(F.max("pdf"), F.lit(False)).alias("pdf"),
        F.min("book_id").alias("least"), F.min(F.when(F.col("epub"), F.col("book_id"))).alias("first_epub"),
    )
    both = by.join(formats_of, "cluster_id", "left")
    clone = F.col("whole") & (F.col("n_maps") == 1)
    apart = (F.coalesce("n_formats", F.lit(0)) == F.coalesce("n_distinct", F.lit(0))) & (F.col("n_books") == 2) & F.col("epub") & F.col("pdf")
    kind = F.when(clone, "CLONE").when(apart, "MULTIFORMAT").otherwise("EDITION")
    return both.select("cluster_id", "n_books", kind.alias("kind"), F.when(clone, 1.0).otherwise(0.75).alias("confidence"), F.coalesce("first_epub", "least").alias("canonical_id"))


def file_hashes(files: DataFrame, edge: int = 65536) -> DataFrame:
    """Ids of files that share their size and sparse hash (size, first and last bytes), with the full hash taken for those alone. `files`: file_id, content."""
    size = F.octet_length("content")
    sparse = F.sha2(F.concat(size.cast("string").cast("binary"), F.substring("content", 1, edge), F.when(size > edge, F.substring("content", F.greatest(size - edge + 1, F.lit(1)), F.lit(edge))).otherwise(F.lit(b""))), 256)
    keyed = files.select("file_id", sparse.alias("sparse"))
    several = keyed.groupBy("sparse").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1")
    asked = files.select("file_id", "content", sparse.alias("sparse")).join(several.select("sparse"), "sparse", "left_semi")
    return asked.select("file_id", "sparse", F.sha2("content", 256).alias("full"))


def semantic_pairs(near: DataFrame, least: float = 0.85) -> DataFrame:
    """Unordered pairs of neighbours above a score."""
    return near.where(F.col("score") > least).groupBy(F.least("query_id", "neighbour_id").alias("left_id"), F.greatest("query_id", "neighbour_id").alias("right_id")).agg(F.max("score").alias("score"))


def reused_answers(asked: DataFrame, cache: DataFrame, most: int = 4, newest: int = 150) -> DataFrame:
    """An answer of the cache by digest, else by equal perceptual hash, else by the nearest hash of the `newest` entries within `most` bits.

    `cache`: digest, phash, answer, seq. The newest entries are few by definition and reach every task.
    """
    exact = cache.groupBy("digest").agg(F.max_by("answer", "seq").alias("by_digest"))
    same = cache.groupBy("phash").agg(F.max_by("answer", "seq").alias("by_hash"))
    told = asked.join(exact, "digest", "left").join(same, "phash", "left")
    few = cache.orderBy(F.desc("seq")).limit(newest).agg(F.collect_list(F.struct("phash", "answer", "seq")).alias("few"))
    d = lambda x: F.bit_count(x["phash"].bitwiseXOR(F.col("phash"))).cast("int")
    close = F.transform(F.filter("few", lambda x: d(x) <= most), lambda x: F.struct(d(x).alias("d"), (-x["seq"]).alias("s"), x["answer"].alias("answer")))
    told = told.crossJoin(F.broadcast(few)).withColumn("near", F.array_min(close))  # one row of at most `newest`
    how = F.when(F.col("by_digest").isNotNull(), "digest").when(F.col("by_hash").isNotNull(), "hash").when(F.col("near").isNotNull(), "near")
    return told.select("cover_id", how.alias("how"), F.coalesce("by_digest", "by_hash", F.col("near")["answer"]).alias("answer")).where("how is not null")


def all_pair_duplicates(books: DataFrame) -> DataFrame:
    """D5 in whole: each later book with the first holder of its ISBN, and with the first of its title and author."""
    lower = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    keyed = books.where("isbn <> ''").select(F.lit("isbn_match").alias("type"), "book_id", F.col("isbn").alias("value")).unionByName(
        books.select(F.lit("title_author_match").alias("type"), "book_id", F.concat(lower("title"), F.lit("|"), lower("author")).alias("value"))
    )
    first = keyed.groupBy("type", "value").agg(F.min("book_id").alias("first_id"))
    return keyed.join(first, ["type", "value"]).where("book_id <> first_id").select("type", "first_id", "book_id", "value")


def duplicate_titles(books: DataFrame) -> DataFrame:
    """Books of a title that several share, a row each, with the smallest id and the number of them. Blank titles are none."""
    keyed = books.select("book_id", F.lower(F.trim("title")).alias("title")).where("title <> ''")
    several = keyed.groupBy("title").agg(F.count("*").alias("n"), F.min("book_id").alias("first_id")).where("n > 1")
    return keyed.join(several, "title").select("title", "n", "first_id", "book_id")


def near_hashes(covers: DataFrame, most: int = 4) -> DataFrame:
    """Distinct 64-bit hashes at a distance of at most `most`, with how many covers hold each.

    Cut into `most` + 2 bands, two such hashes agree in two of them at least. They meet on each pair of bands, about 21 bits, and count where that is the first pair that agrees.
    """
    hashes = covers.where("phash is not null").groupBy("phash").agg(F.count("*").alias("n"))
    n = most + 2
    cuts = [64 * i // n for i in range(n + 1)]
    band = lambda c, i: F.shiftright(c, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    both = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.shiftleft(band(F.col("phash"), i), 32).bitwiseOR(band(F.col("phash"), j)).alias("value")) for i in range(n) for j in range(i + 1, n)]
    split = hashes.select("phash", "n", F.inline(F.array(*both)))
    a, b = split.alias("a"), split.alias("b")
    earlier = F.lit(False)
    for k in range(n):
        earlier = earlier | ((F.col("a.j") > k) & (F.col("a.i") != k) & (band(F.col("a.phash"), k) == band(F.col("b.phash"), k)))
    distance = F.bit_count(F.col("a.phash").bitwiseXOR(F.col("b.phash")))
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.value") == F.col("b.value"))
    return (
        a.join(b, same & (F.col("a.phash") < F.col("b.phash")) & ~earlier & (distance <= most))
        .select(F.col("a.phash").alias("left_hash"), F.col("b.phash").alias("right_hash"), F.col("a.n").alias("left_covers"), F.col("b.n").alias("right_covers"), distance.cast("int").alias("distance"))
    )
