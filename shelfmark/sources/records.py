"""Sources and sinks of catalogue records (I1-I13): scans, provider payloads and sidecars as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text


def ordered(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """A book's values in order of `order`; a book has few of them."""
    return df.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def wide_books(books: DataFrame, authors: DataFrame, identifiers: DataFrame, formats: DataFrame) -> DataFrame:
    """One row a book with its authors in order of link, identifiers by lower-case type, and formats.

    `authors`: book_id, link_id, sort; `identifiers`: book_id, type, value. Books that `rejects` names stay out.
    """
    bad = rejects(identifiers, formats).select("book_id").distinct()
    kept = books.join(bad, "book_id", "left_anti")
    good = lambda df: df.join(bad, "book_id", "left_anti")
    ids = good(identifiers).select("book_id", F.lower("type").alias("k"), "value").groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("k", "value")))).alias("identifiers"))
    return kept.join(ordered(authors, "link_id", "sort", "authors"), "book_id", "left").join(ids, "book_id", "left").join(ordered(good(formats), "format", "format", "formats"), "book_id", "left")


#: Columns that the tables of a library must have.
LIBRARY = {
    "books": ("book_id", "title", "author_sort", "pubdate", "published_date", "series_index", "path", "has_cover", "edition"), "authors": ("book_id", "link_id", "name"), "publishers": ("book_id", "link_id", "name"),
    "series": ("book_id", "link_id", "name"), "languages": ("book_id", "item_order", "link_id", "name"), "tags": ("book_id", "link_id", "name"), "comments": ("book_id", "link_id", "name"),
    "identifiers": ("book_id", "type", "value"), "formats": ("book_id", "format", "name"),
}


def demanded(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the columns of `LIBRARY` alone; a table or column that isn't there is an error."""
    missing = [f"{t}.{c}" for t, cs in LIBRARY.items() for c in cs if t not in tables or c not in tables[t].columns]
    if missing:
        raise ValueError(f"the library lacks {', '.join(missing)}")
    return {t: tables[t].select(*cs) for t, cs in LIBRARY.items()}


def library_rejects(tables: dict[str, DataFrame]) -> DataFrame:
    """Why a book can't be read, a row for each reason: no id or title; several publishers, series or comments; an identifier type or format twice; a format or file name that isn't safe."""
    t = demanded(tables)
    several = lambda name: t[name].groupBy("book_id").agg(F.count("*").alias("n")).where("n > 1").select("book_id", F.lit(name).alias("reason"))
    twice = lambda df, kind, key: df.groupBy("book_id", key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("book_id", F.concat(F.lit(f"{kind}:"), "k").alias("reason"))
    name = F.col("name")
    unsafe = F.coalesce(~F.upper("format").rlike("^[A-Z0-9]{1,16}$") | (name == "") | name.rlike(r"[/\\]") | name.isin(".", ".."), F.lit(True))
    parts = [
        t["books"].where((F.coalesce(F.trim("title"), F.lit("")) == "") | F.coalesce(F.col("book_id") <= 0, F.lit(True))).select("book_id", F.lit("title").alias("reason")),
        *map(several, ("publishers", "series", "comments")), twice(t["identifiers"], "identifier", F.lower("type")), twice(t["formats"], "format", F.upper("format")),
        t["formats"].where(unsafe).select("book_id", F.concat(F.lit("file:"), F.upper("format")).alias("reason")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def library(tables: dict[str, DataFrame]) -> DataFrame:
    """The canonical record of each book that `library_rejects` doesn't name, as one nested row.

    Authors in order of their links, languages by their place, tags by link; names trimmed, empty ones gone, languages in small letters; the
    publication date from either of its columns; identifiers by small type. Each table is aggregated by book before it is joined.
    """
    t = demanded(tables)
    bad = library_rejects(tables).select("book_id").distinct()
    names = lambda df, order, of=lambda x: x: F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.trim("name").alias("v")))), lambda x: of(x["v"])), lambda x: x != "")
    lists = {"authors": names(t["authors"], ["link_id"]), "languages": names(t["languages"], ["item_order", "link_id"], F.lower), "tags": names(t["tags"], ["link_id"])}
    rows = t["books"].join(bad, "book_id", "left_anti")
    for name, made in lists.items():
        rows = rows.join(t[name].groupBy("book_id").agg(made.alias(name)), "book_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    for name in ("publishers", "series", "comments"):
        rows = rows.join(t[name].groupBy("book_id").agg(F.min("name").alias(name)), "book_id", "left")  # one of each, or the book is rejected
    ids = t["identifiers"].join(bad, "book_id", "left_anti").groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lower("type").alias("k"), "value")))).alias("identifiers"))
    files = t["formats"].groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.upper("format").alias("format"), "name"))).alias("files"))
    rows = rows.join(ids, "book_id", "left").join(files, "book_id", "left")
    at = lambda f: F.concat_ws("/", "path", F.concat(f["name"], F.lit("."), F.lower(f["format"])))
    return rows.select(
        "book_id", F.struct(
            "title", "authors", F.coalesce("identifiers", F.create_map().cast("map<string,string>")).alias("identifiers"), "languages", F.col("publishers").alias("publisher"), F.coalesce("pubdate", "published_date").alias("pubdate"), "series",
            F.col("series_index").cast("double").alias("series_index"), F.col("edition").alias("edition_statement"), F.when(F.col("has_cover"), F.concat("path", F.lit("/cover.jpg"))).alias("cover"),
        ).alias("current"), "author_sort", "tags", "comments", F.coalesce(F.transform("files", at), F.array().cast("array<string>")).alias("files"),
    )


def library_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """The records flat, lists joined by `|`."""
    flat = lambda c: F.array_join(c, "|")
    c = F.col("current")
    return library(tables).select(
        "book_id", c["title"].alias("title"), flat(c["authors"]).alias("authors"), flat(F.transform(F.array_sort(F.map_entries(c["identifiers"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("identifiers"), flat(c["languages"]).alias("languages"),
        c["publisher"].alias("publisher"), c["pubdate"].alias("pubdate"), c["series"].alias("series"), c["series_index"].alias("series_index"), c["edition_statement"].alias("edition_statement"), c["cover"].alias("cover"), "author_sort", flat("tags").alias("tags"), "comments", flat("files").alias("files"),
    )


def rejects(identifiers: DataFrame, formats: DataFrame) -> DataFrame:
    """Books with two values of one identifier type, or one format twice."""
    ids = identifiers.groupBy("book_id", F.lower("type").alias("what")).agg(F.countDistinct("value").alias("n")).where("n > 1")
    twice = formats.groupBy("book_id", F.upper("format").alias("what")).agg(F.count("*").alias("n")).where("n > 1")
    return ids.select("book_id", F.concat(F.lit("identifier:"), "what").alias("reason")).unionByName(twice.select("book_id", F.concat(F.lit("format:"), "what").alias("reason")))


def flat_books(wide: DataFrame) -> DataFrame:
    """Authors joined by ` & `, formats by commas in upper case, the first ISBN."""
    return wide.select("book_id", "title", F.array_join("authors", " & ").alias("authors"), F.coalesce(F.upper(F.array_join("formats", ",")), F.lit("")).alias("formats"), F.try_element_at("identifiers", F.lit("isbn")).alias("isbn"))


def scanned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records by book_key: new values where a scan has the book, else the old row; scanned ones get status `scanned`. Both: book_key, title, language, status."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.book_key") == F.col("b.book_key"), "full_outer")
    seen = F.col("b.book_key").isNotNull()
    pick = lambda c: F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(pick("book_key"), pick("title"), pick("language"), F.when(seen, "scanned").otherwise(F.col("a.status")).alias("status"))


def unseen(files: DataFrame, manifest: DataFrame, extensions: tuple[str, ...] = ("epub", "pdf", "mobi", "azw3", "cbz", "cbr")) -> DataFrame:
    """I4: files with a supported extension that the manifest doesn't hold. On a stream the checkpoint is the manifest."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).join(manifest, "path", "left_anti")


VOLUMES = "items array<struct<id string, selfLink string, volumeInfo struct<title string, authors array<string>, publisher string, publishedDate string, language string, industryIdentifiers array<struct<type string, identifier string>>, imageLinks struct<thumbnail string, smallThumbnail string>>>>"
SEARCH = "docs array<struct<key string, title string, author_name array<string>, publisher array<string>, language array<string>, isbn array<string>, first_publish_year int, cover_i bigint>>"


def volumes(payloads: DataFrame) -> DataFrame:
    """A row for each volume of a JSON payload (book_id, payload); the last ISBN of a volume stands. Payloads that aren't read give no rows."""
    rows = payloads.select("book_id", F.posexplode(F.from_json("payload", VOLUMES)["items"]).alias("pos", "x"))
    v = F.col("x.volumeInfo")
    numbers = F.filter(v["industryIdentifiers"], lambda i: F.contains(F.lower(i["type"]), F.lit("isbn")))
    picture = F.coalesce(F.nullif(v["imageLinks"]["thumbnail"], F.lit("")), v["imageLinks"]["smallThumbnail"])
    return rows.select(
        "book_id", "pos", F.concat(F.lit("google_books:"), "x.id").alias("candidate_id"), F.col("x.selfLink").alias("provider_url"), v["title"].alias("title"), F.array_join(v["authors"], " & ").alias("authors"), v["publisher"].alias("publisher"), v["publishedDate"].alias("published"),
        v["language"].alias("language"), F.try_element_at(numbers, F.lit(-1))["identifier"].alias("isbn"), text.volume_cover_url(picture, F.col("x.id")).alias("cover_url"),
    )


def search_docs(payloads: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` documents of a search payload, with the first ISBN, publisher and language of each; a year or cover of 0 is none."""
    rows = payloads.select("book_id", F.posexplode(F.slice(F.from_json("payload", SEARCH)["docs"], 1, most)).alias("pos", "x"))
    first = lambda c: F.get(F.col(f"x.{c}"), F.lit(0)).alias(c)
    key = F.element_at(F.split("x.key", "/"), -1)
    year, cover = F.col("x.first_publish_year"), F.col("x.cover_i")
    return rows.select(
        "book_id", "pos", F.concat(F.lit("openlibrary:"), key).alias("candidate_id"), "x.title", F.array_join("x.author_name", " & ").alias("authors"), first("publisher"), first("language"), first("isbn"),
        F.when(year != 0, year.cast("string")).alias("published"), F.when(cover != 0, F.concat(F.lit("https://covers.openlibrary.org/b/id/"), cover.cast("string"), F.lit("-L.jpg"))).alias("cover_url"),
    )


RECORD = "title string, authors array<struct<name string>>, publishers array<struct<name string>>, languages array<struct<key string>>, publish_date string, cover struct<large string>, url string"


def book_records(payloads: DataFrame) -> DataFrame:
    """One evidence row for each present field of the record that a books payload (book_id, isbn, payload) holds under the book's valid ISBN."""
    asked = payloads.withColumn("code", isbn.canonical13(F.coalesce("isbn", F.lit("")))).where("code is not null")
    told = asked.select("book_id", "code", F.try_element_at(F.from_json("payload", f"map<string,struct<{RECORD}>>"), F.concat(F.lit("ISBN:"), "code")).alias("x")).where("x is not null")
    names = lambda c: F.filter(F.transform(f"x.{c}", lambda a: a["name"]), lambda n: n != "")
    fields = {
        "identifiers": F.col("code"), "title": F.col("x.title"), "authors": F.nullif(F.array_join(names("authors"), " & "), F.lit("")), "publisher": F.get(names("publishers"), F.lit(0)),
        "languages": F.nullif(F.array_join(F.transform("x.languages", lambda a: F.lower(F.element_at(F.split(a["key"], "/"), -1))), ";"), F.lit("")), "pubdate": F.col("x.publish_date"), "cover": F.col("x.cover.large"),
    }
    rows = told.select("book_id", "code", F.col("x.url").alias("source_url"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in fields.items()]))).where("value is not null")
    made = F.sha2(F.concat(F.lit("openlibrary:"), "code", F.lit("\0"), "field"), 256)
    return rows.select(F.concat(F.lit("ev_"), F.substring(made, 1, 20)).alias("evidence_id"), "book_id", "field", "value", "source_url")


def series_matches(payloads: DataFrame, most: int = 3) -> DataFrame:
    """A payload that is a list, an object with a list of `candidates`, or one object; of its first `most` items those that are objects with a title or series.

    `name` stands in for the title, `number` for a chapter that is empty or 0. Volumes are whole numbers, cut if they are numbers and null if they are text that isn't whole; a position that isn't there or doesn't read is the chapter.
    """
    v = F.try_parse_json("payload")
    top = F.schema_of_variant(v)
    wrapped = F.try_variant_get(v, "$.candidates", "variant")
    many = (
        F.when(F.startswith(top, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))
        .when(F.startswith(top, F.lit("OBJECT")) & wrapped.isNotNull(), F.when(F.startswith(F.schema_of_variant(wrapped), F.lit("ARRAY")), F.try_variant_get(wrapped, "$", "array<variant>")))
        .when(F.startswith(top, F.lit("OBJECT")), F.array(v))
    )
    rows = payloads.select("book_id", F.posexplode(F.slice(many, 1, most)).alias("pos", "x")).where(F.startswith(F.schema_of_variant("x"), F.lit("OBJECT")))
    some = lambda c: F.nullif(F.try_variant_get("x", f"$.{c}", "string"), F.lit(""))
    number = lambda c: F.try_variant_get("x", f"$.{c}", "double")
    has = lambda c: some(c).isNotNull() & ~F.coalesce(number(c) == 0, F.lit(False)) | some(c).isNotNull() & F.startswith(F.schema_of_variant(F.try_variant_get("x", f"$.{c}", "variant")), F.lit("STRING"))
    chapter = F.when(has("chapter"), number("chapter")).otherwise(number("number"))
    whole = F.schema_of_variant(F.try_variant_get("x", "$.volume", "variant")) == "STRING"
    volume = F.when(whole, F.when(F.trim(some("volume")).rlike("^[+-]?[0-9]+$"), F.trim(some("volume")).try_cast("int"))).otherwise(F.try_variant_get("x", "$.volume", "double").try_cast("int"))
    out = rows.select("book_id", "pos", F.coalesce(some("title"), some("name")).alias("title"), F.coalesce(some("series"), some("title")).alias("series"), volume.alias("volume"), chapter.alias("chapter"), F.coalesce(number("series_position"), chapter).alias("series_position"))
    return out.where("title is not null or series is not null")


COMIC = "Title string, Series string, Number string, Volume string, Chapter string, Writer string, Publisher string, Year string, Month string, Genre string, LanguageISO string, GTIN string, ISBN string"


def _list(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")


def comic_records(sidecars: DataFrame) -> DataFrame:
    """A comic's sidecar (book_id, xml) as a record; numbers that don't read are null."""
    x = sidecars.select("book_id", F.from_xml("xml", COMIC).alias("x"))
    date = F.when(F.col("x.Year").isNotNull(), F.concat_ws("-", F.trim("x.Year"), F.lpad(F.coalesce(F.trim("x.Month"), F.lit("01")), 2, "0"), F.lit("01")))
    return x.select(
        "book_id", F.trim("x.Title").alias("title"), F.trim("x.Series").alias("series"), text.number(F.col("x.Number")).alias("series_index"), F.trim("x.Volume").try_cast("int").alias("volume"), text.number(F.col("x.Chapter")).alias("chapter"),
        F.array_join(_list(F.col("x.Writer"), ","), " & ").alias("authors"), F.trim("x.Publisher").alias("publisher"), date.alias("published"), F.array_join(_list(F.col("x.Genre"), ","), "|").alias("tags"),
    )


def comic_evidence(sidecars: DataFrame) -> DataFrame:
    """One evidence row for each present field of a sidecar; an ISBN only if it is valid."""
    x = sidecars.select("book_id", F.from_xml("xml", COMIC).alias("x"))
    code = F.coalesce(isbn.canonical13(F.col("x.GTIN")), isbn.canonical13(F.col("x.ISBN")))
    fields = {"title": F.trim("x.Title"), "authors": F.array_join(_list(F.col("x.Writer"), "[;&]"), " & "), "languages": F.lower(F.trim("x.LanguageISO")), "identifiers": code}
    each = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in fields.items()])
    rows = x.select("book_id", F.inline(each)).where("value is not null and value <> ''")
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "book_id", "field"), 256), 1, 20).alias("evidence_id"), "book_id", "field", "value")


OPF = "metadata struct<title: string, creator: array<string>, publisher: string, date: string, language: string, identifier: array<struct<_VALUE: string, _scheme: string>>>"


def opf_records(responses: DataFrame) -> DataFrame:
    """Every OPF record of a response (book_id, body); records start at the XML declaration."""
    parts = F.filter(F.split("body", r"<\?xml"), lambda p: F.contains(p, F.lit("<package")))
    one = responses.select("book_id", F.posexplode(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^[^>]*\?>", ""), r"(</?)(?:dc|opf):", "$1"), r"\sopf:scheme=", " scheme="))).alias("pos", "xml"))
    m = one.select("book_id", "pos", F.from_xml("xml", OPF, {"attributePrefix": "_", "valueTag": "_VALUE"})["metadata"].alias("m"))
    number = F.get(F.filter("m.identifier", lambda i: F.lower(i["_scheme"]) == "isbn"), F.lit(0))["_VALUE"]
    return m.select("book_id", "pos", "m.title", F.array_join("m.creator", " & ").alias("authors"), "m.publisher", F.substring("m.date", 1, 10).alias("published"), "m.language", number.alias("isbn"))


def inserted(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """I8: rows whose evidence_id isn't stored, once each."""
    return rows.join(stored.select("evidence_id"), "evidence_id", "left_anti").dropDuplicates(["evidence_id"])


def conflicts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """I8: ids that are stored with another payload; a caller must stop at any."""
    return rows.select("evidence_id", F.col("payload_sha256").alias("new")).join(stored.select("evidence_id", F.col("payload_sha256").alias("old")), "evidence_id").where("old <> new").select("evidence_id").distinct()


def report(verdicts: DataFrame) -> DataFrame:
    """One JSON line a book, ready for `write.text`."""
    return verdicts.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "verdict", "confidence")))).alias("verdicts"))


def of_types(documents: DataFrame, types: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Documents whose type's name, in any case, is one of `wanted`. `types`: type_id, name."""
    return documents.join(F.broadcast(types.where(F.lower("name").isin(*[w.lower() for w in wanted])).select("type_id")), "type_id", "left_semi")


def in_provider_order(sources: dict[str, DataFrame]) -> DataFrame:
    """Candidates of several providers with `pos`, the provider's rank."""
    each = [df.select("book_id", "title", F.lit(name).alias("provider"), F.lit(i).alias("pos")) for i, (name, df) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, each)
