"""Mining page and snippet text (X1-X12): pages are rows in order of `seq`, one aggregate a book."""

from __future__ import annotations

import json
from functools import lru_cache
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text

#: Patterns of ISBNs in running text, of legal deposit numbers, publishers and years.
IN_CONTEXT = r"(?iU)(?:ISBN(?:-1[03])?\s*[: ]\s*)([0-9Xx][0-9Xx\s-]{8,20}[0-9Xx])"
TAGGED = r"(?iU)\b(?:ISBN(?:-1[03])?[:\s]*)?((?:97[89][-\s]?(?:\d[-\s]?){9}\d)|(?:\d[-\s]?(?:\d[-\s]?){8}[\dXx]))\b(?:\s*\(([^)]+)\))?"
DEPOSIT = r"(?iU)\b(?:D\.?\s*L\.?|Dep[óo]sito\s+Legal)[\s:]*([A-Z]{1,4}|[A-Z]{1,2}-[A-Za-z]+)?[-\s.]*(\d{1,6}(?:\.\d{3})?)[-\s/]*((?:19|20)\d{2}|\d{2})\b"
PUBLISHER = r"(?iU)(?:Publicado por|Published by|Editorial|Ediciones)\s+([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ\s&.,'-]+?)(?:\r?\n|,|\.)"
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
#: What copyright pages and colophons say.
COPYRIGHT = (
    "cataloging-in-publication", "cataloging in publication", "library of congress", "depósito legal", "deposito legal", "d.l.", "dépôt légal", "todos los derechos reservados", "all rights reserved",
    "tous droits réservés", "primera edición", "first edition", "impreso en", "printed in", "copyright ©",
)
COLOPHON = ("se terminó de imprimir", "se termino de imprimir", "acabose de imprimir", "achevé d'imprimer", "talleres de", "talleres gráficos", "colofón", "colofon")
#: Lines that name no author.
NOISE = ("isbn", "translated", "titles by", "arcade publishing")


def _says(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(c), w))


@lru_cache(1)
def _entities() -> dict[str, str]:
    """What stands between & and ; for characters: HTML's names, and the numbers that it reads in another way, as Python's library has them."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return names | {f"#{n}": unescape(f"&#{n};") for n in range(0x80, 0xA0)}


def unescaped(c: Column) -> Column:
    """Entities by name and number, each once; what isn't one stays."""
    name = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    known = F.from_json(F.lit(json.dumps(_entities())), "map<string,string>")

    def one(part: Column) -> Column:
        entity = F.regexp_extract(part, name, 1)
        number = F.when(F.startswith(F.lower(entity), F.lit("#x")), F.conv(F.substring(entity, F.lit(3), F.length(entity)), 16, 10)).when(F.startswith(entity, F.lit("#")), F.substring(entity, F.lit(2), F.length(entity))).cast("long")
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        by_number = F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        # numbers are looked up in decimal, so that hexadecimal ones meet the same exceptions
        read = F.coalesce(F.element_at(known, F.coalesce(F.concat(F.lit("#"), number.cast("string")), entity)), by_number)
        return F.when(entity != "", F.coalesce(F.concat(read, F.substring(part, F.length(entity) + 2, F.length(part))), F.concat(F.lit("&"), part))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))).otherwise(c)


def stripped(html: Column) -> Column:
    """The text of a page: no comments, scripts, styles and tags, entities read."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return unescaped(F.regexp_replace(t, "(?s)<[^>]*>", ""))


def context_isbns(snippets: DataFrame) -> DataFrame:
    """Distinct valid ISBNs of a book in edition context: copyright pages, or the first six pages with a marker."""
    edition = (F.col("source") == "copyright_page") | ((F.col("seq") < 6) & F.lower("text").rlike("copyright|colophon|published by"))
    found = snippets.where(edition).select("book_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(IN_CONTEXT), F.lit(1)), isbn.canonical13)).alias("isbn13"))
    return found.where("isbn13 is not null").distinct()


def content_identifier(books: DataFrame, snippets: DataFrame) -> DataFrame:
    """The single content ISBN of a book, else the embedded one."""
    one = context_isbns(snippets).groupBy("book_id").agg(F.count("*").alias("n"), F.min("isbn13").alias("found"))
    single = F.when(F.col("n") == 1, F.col("found"))
    return books.select("book_id", "isbn").join(one, "book_id", "left").select("book_id", F.coalesce(single, "isbn").alias("identifier"), F.when(single.isNotNull(), "content").when(F.col("isbn").isNotNull(), "embedded").alias("origin"))


def guesses(snippets: DataFrame) -> DataFrame:
    """Title and author from the first lines of a title page."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = snippets.where("source in ('title_page', 'first_pages')").groupBy("book_id").agg(F.min_by("text", "seq").alias("text")).withColumn("lines", lines).where(F.size("lines") > 0)
    head = F.get("lines", F.lit(0))
    by = F.contains(head, F.lit(" by "))
    later = F.get(F.filter(F.slice("lines", 2, 4), lambda x: ~_says(x, NOISE)), F.lit(0))
    part = lambda i: F.trim(F.get(F.split(head, " by ", 2), F.lit(i)))
    return first.select("book_id", F.when(by, part(0)).otherwise(head).alias("title"), F.when(by, part(1)).otherwise(later).alias("author"))


def edition_pages(snippets: DataFrame) -> DataFrame:
    """By book the first copyright page, then the first colophon among the other pages, then the first title page among the rest.

    A page that looks like both is a colophon where another one is the copyright page. Title pages are among the first three, have fewer than a hundred words and no copyright marks.
    """
    t, w = F.col("text"), Window.partitionBy("book_id")
    few = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")) < 100
    rows = snippets.select("book_id", "seq", _says(t, COPYRIGHT).alias("c"), _says(t, COLOPHON).alias("e"), few.alias("few"))
    rows = rows.withColumn("copyright_seq", F.min(F.when(F.col("c"), F.col("seq"))).over(w))
    rows = rows.withColumn("colophon_seq", F.min(F.when(F.col("e") & ~F.col("seq").eqNullSafe(F.col("copyright_seq")), F.col("seq"))).over(w))
    title = ~F.col("c") & (F.col("seq") <= 2) & F.col("few") & ~F.col("seq").eqNullSafe(F.col("colophon_seq"))
    by = rows.groupBy("book_id").agg(F.min("copyright_seq").alias("copyright_seq"), F.min("colophon_seq").alias("colophon_seq"), F.min(F.when(title, F.col("seq"))).alias("title_seq"))
    return by.where("coalesce(copyright_seq, colophon_seq, title_seq) is not null")


def tagged_isbns(snippets: DataFrame) -> DataFrame:
    """The valid ISBNs of a book with the tag in brackets behind them; the last tag wins, the first digital one is primary."""
    whole = F.transform(F.regexp_extract_all("text", F.lit(TAGGED), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, TAGGED, 1).alias("raw"), F.nullif(F.lower(F.trim(F.regexp_extract(m, TAGGED, 2))), F.lit("")).alias("tag")))
    rows = snippets.select("book_id", "seq", F.posexplode(whole).alias("pos", "m")).select("book_id", "seq", "pos", isbn.canonical13(F.col("m.raw")).alias("isbn13"), "m.tag").where("isbn13 is not null")
    place = F.struct("seq", "pos")
    by = rows.groupBy("book_id", "isbn13").agg(F.max_by(F.struct("tag"), place).alias("r"), F.min(place).alias("at")).select("book_id", "isbn13", "r.tag", "at")
    digital = F.coalesce(F.col("tag").rlike("epub|digital|ebook"), F.lit(False))
    primary = by.groupBy("book_id").agg(F.min_by("isbn13", F.struct((~digital).alias("d"), "at")).alias("primary_isbn"))
    return by.join(primary, "book_id").select("book_id", "isbn13", "tag", (F.col("isbn13") == F.col("primary_isbn")).alias("is_primary"))


def imprint(snippets: DataFrame) -> DataFrame:
    """Legal deposit number, publisher and year of a book, each from the first page that has one; the year of a page with a deposit number is that of the deposit, else its largest."""
    year = F.regexp_extract("text", DEPOSIT, 3)
    full = F.when((F.length(year) == 2) & (year.try_cast("int") < 50), F.concat(F.lit("20"), year)).otherwise(year)
    deposit = F.when(year != "", F.regexp_replace(F.concat_ws("-", F.regexp_extract("text", DEPOSIT, 1), F.regexp_replace(F.regexp_extract("text", DEPOSIT, 2), r"\.", ""), full), "^-+|-+$", ""))
    house = F.trim(F.regexp_extract("text", PUBLISHER, 1))
    sound = (F.length(house) > 3) & ~F.lower(house).rlike("autor|traductor|isbn")
    years = F.array_max(F.filter(F.transform(F.regexp_extract_all("text", F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1800, 2030)))
    rows = snippets.select("book_id", "seq", deposit.alias("deposit"), F.when(sound, house).alias("house"), F.coalesce(full.try_cast("int"), years).alias("year"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("book_id").agg(first("deposit").alias("deposit"), first("house").alias("publisher"), first("year").alias("year"))


def budgeted(snippets: DataFrame, most: int) -> DataFrame:
    """Title and copyright snippets in order, `most` characters of a book in all, the last one cut."""
    w = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = snippets.where("source in ('title_page', 'copyright_page')").withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    left = F.greatest(F.lit(most) - F.col("before"), F.lit(0)).cast("int")
    return rows.select("book_id", "seq", "source", F.substring("text", F.lit(1), left).alias("text")).where("text <> ''")


def observations(books: DataFrame, snippets: DataFrame, second: DataFrame) -> DataFrame:
    """X11: what extraction saw of each book, gaps filled from a second source (book_id, title, author, publisher); quality is high where over 500 characters were read."""
    size = snippets.groupBy("book_id").agg(F.sum(F.length("text")).alias("n"))
    seen = books.select("book_id").join(guesses(snippets), "book_id", "left").join(imprint(snippets).select("book_id", "publisher", "year"), "book_id", "left").join(size, "book_id", "left")
    more = second.select("book_id", F.col("title").alias("t2"), F.col("author").alias("a2"), F.col("publisher").alias("p2"))
    return seen.join(more, "book_id", "left").select("book_id", F.coalesce("title", "t2").alias("title"), F.coalesce("author", "a2").alias("author"), F.coalesce("publisher", "p2").alias("publisher"), "year", F.when(F.col("n") > 500, "high").otherwise("medium").alias("quality"))


def egress(snippets: DataFrame, allowed: DataFrame, mark: str = "[text withheld]") -> DataFrame:
    """By book what leaves: its text where allowed, else a mark, with a receipt of characters and hash. `allowed`: book_id."""
    told = snippets.join(allowed.select("book_id", F.lit(True).alias("may")), "book_id", "left").withColumn("out", F.when(F.coalesce("may", F.lit(False)), F.col("text")).otherwise(mark))
    by = told.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "out"))), lambda x: x["out"]), "\n").alias("payload"), F.sum(F.when(F.coalesce("may", F.lit(False)), F.length("text")).otherwise(0)).alias("text_chars"))
    return by.select("book_id", "text_chars", F.sha2("payload", 256).alias("payload_sha256"))


def private_parts(parts: DataFrame, local: bool = False, text: bool = False, images: bool = False, mark: str = "[HIDDEN FOR PRIVACY]") -> DataFrame:
    """What of a message's parts (message_id, seq, kind text or image, content) leaves, in order, with a receipt: characters and images sent, and the hash of what is sent.

    A local target gets all. To others texts leave as a mark unless `text`, images not at all unless `images`. A message all of whose parts stay has an empty payload.
    """
    rows = parts.withColumn("sent", F.when(F.col("kind") == "image", F.lit(local or images)).otherwise(F.lit(True)))
    hide = (F.col("kind") == "text") & F.lit(not (local or text))
    out = F.when(F.col("sent"), F.struct("seq", F.concat("kind", F.lit(":"), F.when(hide, F.lit(mark)).otherwise(F.coalesce("content", F.lit("")))).alias("line")))
    payload = F.array_join(F.transform(F.array_sort(F.collect_list(out)), lambda x: x["line"]), "\n")
    by = rows.groupBy("message_id").agg(
        F.sum(F.when(F.col("sent") & (F.col("kind") == "text") & ~hide, F.length("content")).otherwise(0)).alias("text_chars"), F.count_if(F.col("sent") & (F.col("kind") == "image")).alias("image_count"),
        F.sha2(payload, 256).alias("payload_sha256"),
    )
    return by.withColumn("text_chars", F.coalesce("text_chars", F.lit(0)))
