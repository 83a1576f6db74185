"""Rule tables, merged identifiers, and SQL functions."""

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import rules

TITLES = ["The Economist 2020", "Nature", "naturelle", "DER SPIEGEL 3", "My Financial Times", "my financial times", "MIT Trends", "MIT Technology Review 1", None, "", "All of nature, bound"]


def _plain(title, author, table):
    if not title:
        return None
    for pattern, *rest in table:
        if re.search(pattern, title, re.IGNORECASE):
            return rest
    if author and author.lower() in ("calibre", "unknown"):
        for _, *rest in table:
            if rest[0].lower() in title.lower():
                return rest
    return None


def test_periodicals(spark):
    rows = [(i * 3 + j, t, a) for i, t in enumerate(TITLES) for j, a in enumerate((None, "Calibre", "Jane Austen"))]
    books = spark.createDataFrame(rows, "book_id long, title string, author string")
    got = {r["book_id"]: [r["author"], r["sort"], r["rating"], tuple(r["tags"])] for r in rules.periodicals(books, rules.periodical_rules(spark)).collect()}
    want = {i: p for i, t, a in rows if (p := _plain(t, a, text.PERIODICALS))}
    assert got == want and len(want) > 10
    assert text.PERIODICALS[0][4] == ("Hemeroteca", "Periodicals", "News")


def test_rules_of_a_table(spark):
    """The lowest place wins, in any order of rows; patterns know capitals with accents."""
    table = spark.createDataFrame([(2, "^revista", "B", "B", 5, ["x"]), (1, "españa$", "A", "A", 6, ["y", "z"])], "place int, pattern string, author string, sort string, rating int, tags array<string>")
    books = spark.createDataFrame([(1, "REVISTA DE ESPAÑA", "x"), (2, "Revista", "x"), (3, "other", "x")], "book_id long, title string, author string")
    got = {r["book_id"]: (r["author"], r["rating"], r["tags"]) for r in rules.periodicals(books, table).collect()}
    assert got == {1: ("A", 6, ["y", "z"]), 2: ("B", 5, ["x"])}
    with pytest.raises(ValueError):
        rules.periodicals(books, spark.range(10_001).select(F.col("id").cast("int").alias("place"), *[F.lit("x").alias(c) for c in ("pattern", "author", "sort")], F.lit(1).alias("rating"), F.array(F.lit("t")).alias("tags")))


def test_identifiers_keep_unobserved_namespaces(spark):
    isbn, other = "9780306406157", "9780140328721"
    current = spark.createDataFrame([(1, {"isbn": other, "asin": "B012345678"}), (2, {"ISBN": isbn}), (3, None), (4, {" Goodreads ": " 7 ", "isbn": "nonsense", "x": ""}), (5, {"ISBN": other, "isbn": isbn})], "book_id long, ids map<string,string>")
    decided = spark.createDataFrame([(i, {"isbn": "0-306-40615-2"}) for i in (1, 2, 3, 4, 5, 6)], "book_id long, ids map<string,string>")
    got = {r["book_id"]: (r["target"], r["changed"]) for r in rules.identifier_patches(decided, current).collect()}
    assert got[1] == ({"asin": "B012345678", "isbn": isbn}, True)
    assert got[2] == ({"isbn": isbn}, False) and got[3] == got[6] == ({"isbn": isbn}, True)
    assert got[4] == ({"goodreads": "7", "isbn": isbn}, True) and got[5] == ({"isbn": isbn}, False)


def test_sql_functions(spark):
    rules.sql_functions(spark)
    rows = [(t, a) for t, a in zip(["The Hobbit", "L'étranger", "Los años", "A", "", None, "Plain 'quoted' title"], ["J.R.R. Tolkien", "Johannes van der Waals", "Saint Augustine", "The Economist", "Gabriel García Márquez", None, "Tolkien, J.R.R."])]
    df = spark.createDataFrame(rows, "title string, author string")
    df.createOrReplaceTempView("some_books")
    got = spark.sql("SELECT title_sort(title) AS t, author_sort(author) AS a FROM some_books WHERE title_sort(title) <> 'x' ORDER BY t, a").collect()
    want = df.select(text.title_sort(F.col("title")).alias("t"), text.author_sort(F.col("author")).alias("a")).orderBy("t", "a").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and ("Hobbit, The", "Tolkien, J.R.R.") in [tuple(r) for r in got]
    assert "Python" not in spark.sql("SELECT title_sort(title) FROM some_books")._jdf.queryExecution().executedPlan().toString()


def test_capitals_with_accents(spark):
    df = spark.createDataFrame([("CAPÍTULO UNO", "LIBRO (EDICIÓN EN ESPAÑOL)")], "a string, t string")
    assert df.select(text.clean_author(F.col("a")), text.promoted_title(F.col("t"))).first()[:] == (None, "Libro")


def test_image_types(spark):
    cases = {b"\xff\xd8\xff\xe0": "image/jpeg", b"\x89PNG\r\n\x1a\nrest": "image/png", b"RIFF\x01\x02\x03\x04WEBPVP8L": "image/webp", b"RIFF\x01\x02\x03\x04WAVE": None, b"GIF87a..": "image/gif", b"GIF89a": "image/gif", b"": None, b"BM": None}
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    assert {r["i"]: r["k"] for r in df.select("i", text.image_type(F.col("c")).alias("k")).collect()} == dict(enumerate(cases.values()))


def test_library_demands_its_columns(spark):
    """Tables and columns that are missing are named; an empty library is no error."""
    from shelfmark.sources import records

    tables = {t: spark.createDataFrame([], ", ".join(f"{c} {'long' if c.endswith('_id') or c == 'item_order' else 'boolean' if c == 'has_cover' else 'double' if c == 'series_index' else 'string'}" for c in cs)) for t, cs in records.LIBRARY.items()}
    assert records.library(tables).count() == 0
    with pytest.raises(ValueError, match="tags.link_id"):
        records.library(tables | {"tags": tables["tags"].drop("link_id")})
    with pytest.raises(ValueError, match="series.name"):
        records.library({k: v for k, v in tables.items() if k != "series"})
