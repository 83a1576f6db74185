"""Pairs of duplicates on books made by hand."""

from shelfmark.operators import linkage


def test_pairs_by_isbn_and_by_title(spark):
    books = [(1, "A Tale", "Eve", "9"), (2, " a tale", "EVE ", None), (3, "A Tale", "Adam", "9"), (4, "A Tale", "Eve", "9"), (5, None, "Eve", ""), (6, None, "eve", "")]
    got = {tuple(r) for r in linkage.all_pair_duplicates(spark.createDataFrame(books, "book_id long, title string, author string, isbn string")).collect()}
    title = "title_author_match"
    assert got == {("isbn_match", 1, 3, "9"), ("isbn_match", 1, 4, "9"), (title, 1, 2, "a tale|eve"), (title, 1, 4, "a tale|eve"), (title, 5, 6, "|eve")}


def _books(spark, rows):
    return spark.createDataFrame(rows, "book_id long, title string, author string, isbn string")


def test_blank_titles_are_no_duplicates(spark):
    got = {tuple(r) for r in linkage.duplicate_titles(_books(spark, [(1, " ", "", ""), (2, "", "", ""), (3, None, "", ""), (4, "A ", "", ""), (5, " a", "", ""), (6, "b", "", "")])).collect()}
    assert got == {("a", 2, 4, 4), ("a", 2, 4, 5)}


def test_clusters_with_a_hot_key(spark):
    """A third of the books in one cluster; an ISBN cluster of the very same books isn't told again, one of some of them is."""
    rows = [(i, "The Tale" if i < 300 else f"Book {i}", "Eve", "9780306406157" if i < 300 else "9780140328721" if i < 303 else None) for i in range(900)]
    formats = spark.createDataFrame([(i, f) for i in range(900) for f in ("EPUB", "PDF")[: 1 + i % 2]], "book_id long, format string")
    by_title = linkage.title_author_clusters(_books(spark, rows), formats).collect()
    assert {r["book_id"] for r in by_title} == set(range(300)) and {(r["cluster_id"], r["n_books"], r["action"], r["confidence"]) for r in by_title} == {(0, 300, "INSPECT", 0.85)}
    by_isbn = linkage.isbn_clusters(_books(spark, rows), formats).collect()
    assert sorted((r["book_id"], r["cluster_id"], r["n_books"]) for r in by_isbn) == [(i, 300, 3) for i in (300, 301, 302)]
    assert linkage.title_author_clusters(_books(spark, rows[:0]), formats).count() == 0


def test_gaps_of_wide_series(spark):
    """A span that is too wide is left out before anything is listed."""
    from shelfmark.operators import series

    rows = [(1, "s", 1.0, "B & A"), (2, "s", 4.0, "C"), (3, "s", 2.5, None), (4, "wide", 1.0, "X"), (5, "wide", 9999.0, "X"), (6, "late", 3.0, ""), (7, "late", 5.0, "Y"), (8, None, 1.0, "Z"), (9, "nan", float("nan"), "Z"), (10, "one", 1.0, "Z")]
    books = spark.createDataFrame(rows, "book_id long, series string, series_index double, author string")
    assert {tuple(r) for r in series.wishlist(books).collect()} == {("s", v, "A & B & C", f"s #{v} A & B & C") for v in (2, 3)} | {("late", v, "Y", f"late #{v} Y") for v in (1, 2, 4)}
    got = {r["series"]: (r["authors"], r["missing"], r["summary"]) for r in series.topology(books).collect()}
    assert got == {"s": ("B & A", [2, 3], "Missing volumes: 2, 3 (Contains side novellas: 2.5)"), "late": ("Y", [1, 2, 4], "Missing volumes: 1, 2, 4")}


def test_near_hashes_by_brute_force(spark):
    """Signed hashes, all distances up to four, each pair once."""
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    rows = base + [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5)]
    signed = [x - (1 << 64) if x >> 63 else x for x in rows]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed + signed[:3])] + [(999, None)], "cover_id long, phash long")
    distinct = sorted(set(signed))
    want = {(a, b, bin((a ^ b) & ((1 << 64) - 1)).count("1")) for i, a in enumerate(distinct) for b in distinct[i + 1 :]}
    got = [(r["left_hash"], r["right_hash"], r["distance"]) for r in linkage.near_hashes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[2] <= 4} and len(got) > 150
