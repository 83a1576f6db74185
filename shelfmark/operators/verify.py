"""Field verification (V1-V11) as one projection over declared and observed values, and the book's roll-up.

A verdict is a struct of field, verdict, confidence, flag and review. Rules are
`case` ladders; the first line that holds decides. Nothing is shuffled: a
book's verdicts stay in its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from shelfmark.functions import isbn, text

HIGH_RISK = ("author_swap", "isbn_conflict", "edition_ambiguous", "cover_mismatch", "wrong_book", "series_mismatch", "publisher_mismatch")


FIELDS = 11
#: Normals of names that stand for no author.
SENTINELS = ("unknown", "anonymous", "n n", "various", "n a", "desconocido", "calibre", "mantesh", "chenjin5 com")


class Ladder:
    def __init__(self):
        self.column: Column | None = None

    def when(self, condition: Column, verdict: str, confidence: int | Column, flag: str | Column = "", review: bool | Column = False, reason: str | Column = "") -> Ladder:
        plain = lambda x: x if isinstance(x, Column) else F.lit(x)
        out = F.struct(F.lit(verdict).alias("verdict"), plain(confidence).cast("int").alias("confidence"), plain(flag).alias("flag"), plain(review).alias("review"), plain(reason).alias("reason"))
        self.column = F.when(condition, out) if self.column is None else self.column.when(condition, out)
        return self


def _quoted(c: Column) -> Column:
    """A text in quotes as reasons show it: single ones, double ones around a text that holds only single ones."""
    inner = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    both = F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(both)


def _shown(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, _quoted), ", "), F.lit("]"))


def _says(template: str, **parts: Column) -> Column:
    """A reason with its parts in the places of {names}."""
    out, rest = [], template
    for name in sorted(parts, key=lambda n: template.index(f"{{{n}}}")):
        before, _, rest = rest.partition(f"{{{name}}}")
        out += [F.lit(before), F.coalesce(parts[name], F.lit("None"))]
    return F.concat(*out, F.lit(rest))


def _two(r: Column) -> Column:
    return F.format_string("%.2f", r)


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def isbn_facts(df: DataFrame, declared: Column, observed: Column) -> DataFrame:
    """Adds the columns that `isbn_rule` reads: both values without spaces and hyphens, and what holds of each.

    As columns of their own they are computed once; nested in the ladder they
    would be one expression of thousands of nodes.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s-]", "")
    df = df.withColumns({"isbn_d": plain(declared), "isbn_o": plain(observed)})
    return df.withColumns({f"isbn_{side}_{name}": of(F.col(f"isbn_{side}")) for side in "do" for name, of in (("10", isbn.isbn10_valid), ("13", isbn.isbn13_valid), ("turned", isbn.turned))})


def isbn_rule() -> Column:
    """V1, over the columns of `isbn_facts`."""
    d, o = F.col("isbn_d"), F.col("isbn_o")
    d13, o13 = F.col("isbn_d_13"), F.col("isbn_o_13")
    d_ok, o_ok = F.col("isbn_d_10") | d13, F.col("isbn_o_10") | o13
    return (
        Ladder().when((d == "") & (o == ""), "ambiguous", 0, reason="No ISBN declared and none observed.").when((d == "") & o_ok, "missing", 95, reason=_says("Found valid ISBN {o} on copyright page; not declared in Calibre.", o=o))
        .when(d == "", "ambiguous", 40, reason=_says("Found ISBN-shaped string {o} but checksum invalid.", o=_quoted(o))).when(o == "", "ambiguous", 50, reason="ISBN declared but no ISBN found on extracted copyright page.")
        .when(~d_ok & ~o_ok, "ambiguous", 30, reason="Both ISBNs have invalid checksums.").when(d == o, "confirmed", 99, reason="ISBNs match exactly.")
        .when((F.length(d) == 10) & o13 & (F.col("isbn_d_turned") == o), "confirmed", 90, reason="Declared ISBN-10 converts to observed ISBN-13.")
        .when((F.length(o) == 10) & d13 & (F.col("isbn_o_turned") == d), "confirmed", 90, reason="Observed ISBN-10 converts to declared ISBN-13.")
        .when(d_ok & o_ok, "mismatch", 98, "isbn_conflict", True, _says("ISBN conflict: declared {d} but book has {o}.", d=d, o=o))
        .when(o_ok, "mismatch", 92, "isbn_conflict", True, _says("Declared ISBN has invalid checksum; book has valid {o}.", o=o))
        .when(F.lit(True), "mismatch", 88, "isbn_conflict", True, _says("Observed ISBN {o} has invalid checksum.", o=o)).column
    )


def title_facts(df: DataFrame, declared: str, observed: str) -> DataFrame:
    """Adds the columns that `title_rule` reads. The sequence ratio runs over the pairs alone whose normals differ and aren't empty."""
    d, o = F.col(declared), F.col(observed)
    raw = F.trim(F.coalesce(d, F.lit("")))
    df = df.withColumns({
        "title_n": text.verify_key(d), "title_on": text.verify_key(o), "title_clean": text.clean_title(d), "title_bare": F.regexp_replace(raw, r"[!?.,;:*]+$", ""),
        "title_tag": text.edition_tagged(d), "title_otag": text.edition_tagged(o), "title_raw": raw,
    })
    n, on = F.col("title_n"), F.col("title_on")
    df = df.withColumns({"title_clean_n": text.verify_key(F.col("title_clean")), "title_bare_n": text.verify_key(F.col("title_bare"))})
    ask = (n != on) & (n != "") & (on != "")
    return df.withColumn("title_r", F.when(n == on, 1.0).otherwise(text.sequence_ratio(F.when(ask, n), F.when(ask, on))))


def title_rule(d: Column, o: Column, low: Column) -> Column:
    """V2, over the columns of `title_facts`."""
    n, on, r, raw = F.col("title_n"), F.col("title_on"), F.col("title_r"), F.col("title_raw")
    low = F.coalesce(low, F.lit(False))
    inside = F.contains(n, on) | F.contains(on, n)
    return (
        Ladder().when(d.isNull() & o.isNull(), "ambiguous", 0, reason="No title declared and none observed.").when(d.isNull() & (o != "") & low, "ambiguous", 55, reason="OCR quality is low; cannot trust title.")
        .when(d.isNull() & (o != ""), "missing", F.when(F.length(o) >= 3, 95).otherwise(70), reason=_says("Title found on title page: {o}.", o=_quoted(o)))
        .when((d != "") & o.isNull(), "ambiguous", 50, reason="Title declared but extraction returned no title-page text.").when((n == "") | (on == ""), "ambiguous", 40, reason="One or both titles are empty after normalization.")
        .when((F.col("title_clean") != "") & (F.col("title_clean") != raw) & (F.col("title_clean_n") == on), "mismatch", 95, reason=_says("Declared title contains scraper/extension junk; canonical title is {c}.", c=_quoted(F.col("title_clean"))))
        .when((F.col("title_bare") != "") & (F.col("title_bare") != raw) & (F.col("title_bare_n") == on), "mismatch", 80, reason="Trailing punctuation noise on declared title.")
        .when(F.contains(F.lower(raw), F.lit(" by ")) & (on == F.trim(F.get(F.split(n, " by "), F.lit(0)))), "mismatch", 88, reason="'by Author' suffix noise on declared title.")
        .when(F.col("title_tag") & ~F.col("title_otag") & (r >= 0.9), "mismatch", 82, reason=_says("Declared title has edition annotation; canonical is {o}.", o=_quoted(o)))
        .when(F.lower(raw).rlike(r"_|\.(epub|pdf|mobi)$") & (r >= 0.5), "mismatch", 92, reason="Declared title looks filename-derived.")
        .when((r >= 0.95) & low, "ambiguous", 55, reason="OCR quality is low; cannot confirm match.").when(r >= 0.95, "confirmed", 95, reason=_says("Titles match (similarity {r}).", r=_two(r)))
        .when(inside & (F.abs(F.length(n) - F.length(on)) <= 20), "confirmed", 85, reason="Titles match after normalization (substring or wrapped).")
        .when(inside & F.contains(n, on) & (F.length(on) < F.length(n)), "mismatch", 80, reason=_says("Declared title has edition annotation; canonical is {o}.", o=_quoted(o)))
        .when(inside, "mismatch", 80, reason=_says("Declared title has noise or annotation; canonical is {o}.", o=_quoted(o)))
        .when(r < 0.4, "mismatch", 95, "wrong_book", reason=_says("Titles differ significantly (similarity {r}).", r=_two(r))).when(r < 0.7, "mismatch", 95, reason=_says("Titles differ significantly (similarity {r}).", r=_two(r)))
        .when(F.lit(True), "ambiguous", 60, reason=_says("Title similarity {r} is ambiguous; needs LLM adjudication.", r=_two(r))).column
    )


_FACTS = ("paired", "apart", "declared_covered", "observed_covered")
_EXTRAS = ("declared_extra", "observed_extra")


def _compare(ds: list[str], os: list[str], dd: list[str], od: list[str], latin: tuple[list[str], ...], alike) -> tuple:
    """How two author lists relate: raw normals and normals of display names, each name's two forms together, and the four lists in Latin letters.

    Names are alike in Latin letters; surnames are compared as they are written. Last come the places of names that the other list doesn't have.
    """
    to = {a: b for plain, turned in zip((ds, os, dd, od), latin) for a, b in zip(plain, turned)}

    def surname(a: str, b: str) -> bool:
        x, y = a.split(), b.split()
        return bool(x and y) and x[-1] in (y[-1], y[0])

    near = lambda a, b: bool(a and b) and alike(to[a], to[b]) >= 0.9
    covers = lambda xs, ys: all(any(x == y or near(x, y) or surname(x, y) for y in ys) for x in xs)
    meets = lambda a, ar, bs, brs: any(near(a, b) or surname(ar, br) for b, br in zip(bs, brs))
    paired = len(ds) == len(os) and all(meets(a, ar, od, os) for a, ar in zip(dd, ds)) and all(meets(a, ar, dd, ds) for a, ar in zip(od, os))
    apart = not set(dd) & set(od) and not any(near(a, b) for a in dd for b in od) and not any(surname(a, b) for a in ds for b in os)
    extra = lambda xs, ys: [i for i, a in enumerate(xs) if not any(near(a, b) or surname(a, b) for b in ys)]
    return paired, apart, covers(dd, od), covers(od, dd), extra(ds, os), extra(os, ds)


@F.pandas_udf(StructType([StructField(n, BooleanType()) for n in _FACTS] + [StructField(n, ArrayType(IntegerType())) for n in _EXTRAS]))
def _author_relation(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Null for lists that are decided already. Four lists as they are written, then the same in Latin letters."""
    alike = lru_cache(1 << 16)(lambda a, b: SequenceMatcher(None, a, b).ratio())
    one = lru_cache(1 << 16)(lambda *lists: _compare(*lists[:4], lists[4:], alike))
    for columns in parts:
        told = pd.DataFrame([(None,) * 6 if row[0] is None else one(*map(tuple, row)) for row in zip(*columns)], columns=[*_FACTS, *_EXTRAS])
        yield told.astype(dict.fromkeys(_FACTS, "boolean"))


def author_facts(df: DataFrame, declared: str, observed: str) -> DataFrame:
    """Adds the columns that `authors_rule` reads: the lists, whether they are equal in one of three forms, and how they relate if not.

    Each author's display form is paired with its own raw form.
    """
    names = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "&"), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumns({"authors_d": names(declared), "authors_o": names(observed)})
    d, o = F.col("authors_d"), F.col("authors_o")
    form = lambda of: lambda c: F.transform(c, of)
    key = form(text.verify_key)  # each step names its input once, so that no lambda grows with the one before
    forms = {"raw": key, "display": lambda c: key(F.transform(c, text.author_display))}
    df = df.withColumns({f"authors_{k}_{s}": f(c) for k, f in forms.items() for s, c in (("d", d), ("o", o))})
    same = lambda x, y: F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y))
    sort = lambda c: key(F.transform(c, text.author_sort))
    both = (F.size(d) > 0) & (F.size(o) > 0)
    equal = F.when(~both, False).when(same(F.col("authors_raw_d"), F.col("authors_raw_o")), True).when(same(F.col("authors_display_d"), F.col("authors_display_o")), True).otherwise(same(sort(d), sort(o)))
    df = df.withColumn("authors_equal", equal)
    ask = lambda c: F.when(both & ~F.col("authors_equal"), c)
    lists = [F.col(f"authors_{k}_{s}") for k, s in (("raw", "d"), ("raw", "o"), ("display", "d"), ("display", "o"))]
    return df.withColumn("authors_how", _author_relation(*map(ask, lists), *[ask(F.transform(c, text.transliterated)) for c in lists]))


def authors_rule(low: Column) -> Column:
    """V3, over the columns of `author_facts`."""
    d, o, how, low = F.col("authors_d"), F.col("authors_o"), F.col("authors_how"), F.coalesce(low, F.lit(False))
    nobody = F.forall("authors_display_d", lambda x: x.isin(*SENTINELS))
    named = lambda names, where: F.transform(how[where], lambda i: F.get(names, i))
    more = F.coalesce(F.size(how["declared_extra"]) > 0, F.lit(False))
    return (
        Ladder().when((F.size(d) == 0) & (F.size(o) == 0), "ambiguous", 0, reason="No authors declared and none observed.").when(F.size(d) == 0, "missing", 95, reason=_says("Author(s) found on title page: {o}.", o=_shown(o)))
        .when(F.size(o) == 0, "ambiguous", 50, reason="Authors declared but extraction returned no author info.").when(F.col("authors_equal") & low, "ambiguous", 55, reason="OCR quality is low; cannot confirm match.")
        .when(F.col("authors_equal"), "confirmed", 99, reason="Authors match.").when(how["paired"], "confirmed", 88, reason="Authors match (transliteration tolerance).")
        .when(nobody, "mismatch", 92, reason=_says("Declared author is sentinel; book has real author(s): {o}.", o=_shown(o)))
        .when(how["apart"], "mismatch", 92, "author_swap", True, _says("Author swap: declared {d} but book has {o}.", d=_shown(d), o=_shown(o)))
        .when(how["observed_covered"] & ~how["declared_covered"], "mismatch", 88, F.when(more, "author_swap").otherwise(""), more, _says("Declared authors include hallucinated extra(s): {x}.", x=_shown(named(d, "declared_extra"))))
        .when(how["declared_covered"] & ~how["observed_covered"], "mismatch", 92, reason=_says("Missing co-author(s): {x}.", x=_shown(named(o, "observed_extra")))).when(F.lit(True), "mismatch", 80, reason="Author sets partially overlap.").column
    )


def publisher_facts(df: DataFrame, declared: str, observed: str) -> DataFrame:
    """Adds the columns that `publisher_rule` reads."""
    df = df.withColumns({"publisher_n": text.verify_key(F.col(declared)), "publisher_on": text.verify_key(F.col(observed))})
    n, on = F.col("publisher_n"), F.col("publisher_on")
    ask = (n != on) & F.col(declared).isNotNull() & F.col(observed).isNotNull()
    return df.withColumn("publisher_r", text.sequence_ratio(F.when(ask, n), F.when(ask, on)))


def publisher_rule(d: Column, o: Column) -> Column:
    """V4, over the columns of `publisher_facts`."""
    n, on, r = F.col("publisher_n"), F.col("publisher_on"), F.col("publisher_r")
    return (
        Ladder().when(d.isNull() & o.isNull(), "ambiguous", 0, reason="No publisher declared and none observed.").when(d.isNull() & (o != ""), "missing", 80, reason=_says("Publisher found on copyright page: {o}.", o=_quoted(o)))
        .when((d != "") & o.isNull(), "ambiguous", 50, reason="Publisher declared but extraction found none.").when(n == on, "confirmed", 99, reason="Publisher matches exactly.")
        .when((r >= 0.6) & (F.contains(on, n) | F.contains(n, on)), "confirmed", 85, reason=_says("Publisher variant only (similarity {r}).", r=_two(r)))
        .when(r < 0.5, "mismatch", 85, "publisher_mismatch", True, _says("Publisher mismatch (similarity {r}).", r=_two(r))).when(F.lit(True), "ambiguous", 60, reason=_says("Publisher similarity {r}; ambiguous.", r=_two(r))).column
    )


def date_rule(d: Column, o: Column) -> Column:
    text_ = lambda c: F.regexp_extract(c, r"^\s*(\d{4})", 1)
    year = lambda c: text_(c).try_cast("int")
    return (
        Ladder().when(_empty(d) & _empty(o), "ambiguous", 0, reason="No date declared and none observed.").when(_empty(d), "missing", 85, reason=_says("Date found on copyright page: {o}.", o=_quoted(o)))
        .when(_empty(o), "ambiguous", 50, reason="Date declared but extraction found none.").when(year(d).isNull() | year(o).isNull(), "ambiguous", 40, reason="Date parse failed.")
        .when(year(d) == year(o), "confirmed", 90, reason="Year matches.").when(F.abs(year(d) - year(o)) == 1, "confirmed", 80, reason="Years off by one; acceptable.")
        .when(F.lit(True), "mismatch", 90, "", True, _says("Year mismatch: declared {d}, observed {o}.", d=text_(d), o=text_(o))).column
    )


def language_rule(d: Column, o: Column) -> Column:
    n, on = F.lower(F.trim(d)), F.lower(F.trim(o))
    return (
        Ladder().when(_empty(d) & _empty(o), "ambiguous", 0, reason="No language declared and none observed.").when(_empty(d), "missing", 90, reason=_says("Language detected: {o}.", o=_quoted(o)))
        .when(_empty(o), "ambiguous", 50, reason="Language declared but body sample too small.").when(n == on, "confirmed", 99, reason="Language matches.")
        .when(F.lit(True), "mismatch", 90, reason=_says("Language mismatch: declared {d}, detected {o}.", d=n, o=on)).column
    )


def series_rule(d: Column, o: Column, sampled: Column) -> Column:
    same = text.verify_key(d) == text.verify_key(o)
    return (
        Ladder().when(_empty(d) & _empty(o) & sampled, "confirmed", 95, reason="No series declared and none observed.").when(_empty(d) & _empty(o), "confirmed", 90, reason="No series declared; headers not sampled.")
        .when(_empty(d), "missing", 85, reason=_says("Series header found: {o}.", o=_quoted(o))).when(_empty(o) & ~sampled, "ambiguous", 50, reason="Series declared but headers not sampled.")
        .when(_empty(o), "mismatch", 80, "series_mismatch", True, "Series declared but no series header on running pages.").when(same, "confirmed", 95, reason="Series matches.")
        .when(F.lit(True), "mismatch", 85, "series_mismatch", True, "Series differs.").column
    )


#: What reasons call a number: without any, found, declared alone, equal, different.
NUMBERS = {
    "series_index": ("No series_index declared and none observed.", "Series index found in header: {o}.", "Series_index declared but not found in header sample.", "Series index matches.", "Series index mismatch: declared {d}, observed {o}."),
    "volume": ("No volume declared and none observed.", "Volume found: {o}.", "Volume declared but not found in content sample.", "Volume matches.", "Volume mismatch: declared {d}, observed {o}."),
    "chapter": ("No chapter declared and none observed.", "Chapter found: {o}.", "Chapter declared but not found in content sample.", "Chapter matches (decimal).", "Chapter mismatch: declared {d}, observed {o}."),
    "series_position": ("No series_position declared and none observed.", "Series position found: {o}.", "Series position declared but not found in content sample.", "Series position matches.", "Series position mismatch: declared {d}, observed {o}."),
}


def number_rule(d: Column, o: Column, field: str = "series_index") -> Column:
    """V8-V11; volumes are compared as whole numbers, the others within a hundredth."""
    whole = field == "volume"
    same = F.bround(d) == F.bround(o) if whole else F.abs(d - o) < 0.01
    show = lambda c: (F.bround(c).cast("long") if whole else c).cast("string")
    none, found, alone, equal, other = NUMBERS[field]
    return (
        Ladder().when(d.isNull() & o.isNull(), "confirmed", 90, reason=none).when(d.isNull(), "missing", 85, reason=_says(found, o=o.cast("string"))).when(o.isNull(), "ambiguous", 50, reason=alone)
        .when(same, "confirmed", 95, reason=equal).when(F.lit(True), "mismatch", 90, reason=_says(other, d=show(d), o=show(o))).column
    )


def verdicts(pairs: DataFrame, rules: dict[str, Column], values: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """book_id and an array of verdicts; `rules` by field, over the columns of `pairs`; `values`: what is declared and observed, as strings."""
    values = values or {}
    none = F.lit(None).cast("string")
    each = [F.struct(F.lit(f).alias("field"), r.alias("v"), *[c.cast("string").alias(n) for c, n in zip(values.get(f, (none, none)), ("declared", "observed"))]) for f, r in rules.items()]
    return pairs.select("book_id", F.array(*each).alias("verdicts"))


def all_verdicts(pairs: DataFrame) -> DataFrame:
    """V1-V11 in one row a book. `pairs`: book_id, d_ and o_ columns of title, authors, isbn, publisher, date, language, series, series_index, volume, chapter, series_position, and sampled, low."""
    d, o = (lambda f: F.col(f"d_{f}")), (lambda f: F.col(f"o_{f}"))
    df = publisher_facts(author_facts(title_facts(isbn_facts(pairs, d("isbn"), o("isbn")), "d_title", "o_title"), "d_authors", "o_authors"), "d_publisher", "o_publisher")
    number = lambda f: number_rule(text.number(d(f)), text.number(o(f)), f)
    rules = {
        "isbn": isbn_rule(), "title": title_rule(d("title"), o("title"), F.col("low")), "authors": authors_rule(F.col("low")), "publisher": publisher_rule(d("publisher"), o("publisher")),
        "published_date": date_rule(d("date"), o("date")), "language": language_rule(d("language"), o("language")), "series": series_rule(d("series"), o("series"), F.col("sampled")),
        "series_index": number("series_index"), "volume": number("volume"), "chapter": number("chapter"), "series_position": number("series_position"),
    }
    source = {"published_date": "date"}
    values = {f: (d(source.get(f, f)), o(source.get(f, f))) for f in rules}
    return verdicts(df, rules, values | {"authors": tuple(F.array_join(f"authors_{s}", " & ") for s in "do")})


def rows(df: DataFrame, fields: int) -> DataFrame:
    """A row for each book and field. The places are exploded, not the verdicts: a filter derived from the ladders would hold all of them."""
    x = F.get("verdicts", F.col("place"))
    return (
        df.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(fields - 1)))).select("book_id", x.alias("x"))
        .select("book_id", "x.field", "x.v.verdict", "x.v.confidence", "x.v.flag", "x.v.review", "x.v.reason")
    )


def roll_up(df: DataFrame) -> DataFrame:
    """Confidence, flags, patch, action, eligibility, the gate's reason and the fields' reasons of each book, from its array of verdicts.

    Ambiguous with nothing declared and nothing observed, null or empty, is no doubt.
    """
    v = F.col("verdicts")
    decided = F.filter(v, lambda x: x["v"]["verdict"] != "ambiguous")
    patched = F.filter(v, lambda x: x["v"]["verdict"].isin("mismatch", "missing"))
    mean = lambda a: F.when(F.size(a) == 0, 0).otherwise(F.floor(F.aggregate(a, F.lit(0), lambda s, x: s + x["v"]["confidence"]) / F.size(a)))
    flags = F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: x["v"]["flag"]), lambda f: f != "")))
    out = df.select("book_id", "verdicts", mean(decided).cast("int").alias("confidence"), flags.alias("flags"), patched.alias("patched"), F.size(decided).alias("n_decided"))
    risky = F.arrays_overlap("flags", F.array(*[F.lit(x) for x in HIGH_RISK]))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    silent = lambda x: (x["v"]["verdict"] == "ambiguous") & ~there(x["declared"]) & ~there(x["observed"])
    unsure = F.exists(v, lambda x: (x["v"]["verdict"] == "ambiguous") & ~silent(x))
    reasons = F.transform(F.filter(v, lambda x: ~silent(x) & (x["v"]["reason"] != "")), lambda x: F.concat(F.lit("["), x["field"], F.lit("] "), x["v"]["reason"]))
    action = (
        F.when(risky | unsure, "needs_review").when((F.col("n_decided") == 0) | (F.size("patched") == 0), "no_change")
        .when(F.col("confidence") >= 85, "suggest_fix").when(F.col("confidence") >= 70, "needs_review").otherwise("defer")
    )
    out = out.withColumns({"action": action, "risky": risky, "reasons": reasons})
    sound = F.forall("patched", lambda x: (x["v"]["confidence"] >= 75) & ~x["v"]["review"])
    eligible = (F.col("action") == "suggest_fix") & (mean(F.col("patched")) >= 80) & sound
    out = out.withColumn("eligible", eligible)
    gate = F.when(~F.col("eligible"), F.concat(F.lit("not eligible: "), "action")).when(F.col("risky"), "high risk").when(F.col("confidence") < 80, "confidence under 80").when(F.size("patched") == 0, "no patch").otherwise("ok")
    values = F.array_join(F.transform("patched", lambda x: F.concat(x["field"], F.lit("="), F.coalesce(x["observed"], F.lit("")))), ";")
    return out.select("book_id", "confidence", F.array_join("flags", ",").alias("flags"), F.array_join("patched.field", ",").alias("patch"), "action", "eligible", gate.alias("gate"), values.alias("patch_values"), "reasons")


def patch_risks(current: DataFrame, patch: DataFrame) -> DataFrame:
    """Flags of a patch: no author in common, another ISBN. Both: book_id, authors (joined by `&`), isbn."""
    names = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "&"), lambda x: F.trim(x)), lambda x: x != "")
    both = current.select("book_id", names(F.col("authors")).alias("a"), F.col("isbn").alias("i")).join(patch.select("book_id", names(F.col("authors")).alias("b"), F.col("isbn").alias("j")), "book_id")
    swap = (F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")
    other = (F.col("i") != "") & (F.col("j") != "") & (F.col("i") != F.col("j"))
    return both.select("book_id", F.concat_ws(",", F.when(swap, "author_swap"), F.when(F.coalesce(other, F.lit(False)), "isbn_conflict")).alias("risks"))


def threshold_action(action: Column, confidence: Column, risks: Column) -> Column:
    """A suggested fix under 70 is deferred, under 90 or with a flag reviewed."""
    return F.when(action != "suggest_fix", action).when(confidence < 70, "defer").when((confidence < 90) | (risks != ""), "needs_review").otherwise(action)


def adjudicated(verdict_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to ambiguous rows: flags are united, an ambiguous answer keeps the old confidence, others are clamped to 0..100.

    `answers`: book_id, field, answer, answer_confidence, answer_flag.
    """
    both = verdict_rows.join(answers, ["book_id", "field"], "left")
    told = (F.col("verdict") == "ambiguous") & F.col("answer").isNotNull()
    flags = F.array_join(F.array_sort(F.array_distinct(F.filter(F.array("flag", F.when(told, F.coalesce("answer_flag", F.lit(""))).otherwise("")), lambda x: x != ""))), ",")
    confidence = F.when(told & (F.col("answer") != "ambiguous"), F.greatest(F.lit(0), F.least(F.lit(100), "answer_confidence"))).otherwise(F.col("confidence"))
    return both.select("book_id", "field", F.when(told, F.col("answer")).otherwise(F.col("verdict")).alias("verdict"), confidence.cast("int").alias("confidence"), flags.alias("flags"))


def open_requests(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The distinct prompts that no answer younger than `hours` covers. `requests`: prompt; `cache`: prompt_hash, created_at."""
    asked = requests.select(F.sha2("prompt", 256).alias("prompt_hash")).groupBy("prompt_hash").agg(F.count("*").alias("n_requests"))
    return asked.join(cache.where(F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours))).select("prompt_hash"), "prompt_hash", "left_anti")


def quoted(observations: DataFrame, snippets: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Observations of allowed fields whose quote stands in a snippet of the book, with the first such snippet's place."""
    both = observations.where(F.col("field").isin(*fields) & (F.col("quote") != "")).join(snippets.select("book_id", "seq", "source", "text"), "book_id").where(F.contains("text", F.col("quote")))
    return both.groupBy("book_id", "field", "quote").agg(F.min_by("source", "seq").alias("source"), F.min("seq").alias("seq"))
