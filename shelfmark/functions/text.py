"""Normalisers of titles, names and small text facts as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Leading articles of duplicate keys.
KEY_ARTICLES = "the|a|an|el|la|los|las|un|una|der|die|das"
#: Leading articles of title sorting, first match wins.
SORT_ARTICLES = ("the ", "a ", "an ", "el ", "la ", "los ", "las ", "un ", "una ", "unos ", "unas ", "der ", "die ", "das ", "ein ", "eine ", "le ", "les ", "l'", "une ", "des ", "il ", "lo ", "i ", "gli ")
#: Marks that distributors leave in titles, taken out in this order.
JUNK = (
    r"\[welib\.org\]", r"\(z-library\)", r"\[z-lib\.org\]", r"\[oceanofpdf\.com\]", r"\[libgen\.li\]", r"\[b-ok\.org\]", r"\bv\d+(\.\d+)+\b",
    r"\[ocr\]", r"\[retail\]", r"\[leather bound\]", r"\(illustrated\)", r"\(annotated\)", r"^microsoft word\s*-\s*", r"_print$",
)
EXTENSIONS = ("epub", "pdf", "mobi", "azw3", "djvu", "cbz", "cbr")
#: Corporate names and their sort keys, compound surnames, surname particles.
CORPORATE = {
    "the economist": "Economist, The", "the new yorker": "New Yorker, The", "financial times": "Financial Times", "der spiegel": "Spiegel, Der", "spiegel online": "Spiegel Online",
    "the wall street journal": "Wall Street Journal, The", "nature": "Nature", "lonely planet": "Lonely Planet", "harvard business review": "Harvard Business Review",
}
#: What an edition tag in brackets says.
EDITION_TAG = (
    r"\s*[\(\[](?:special(?:\s+edition)?|anniversary(?:\s+edition)?|collector'?s?(?:\s+edition)?|deluxe(?:\s+edition)?|hardcover|paperback|first(?:\s+edition)?|\d+(?:st|nd|rd|th)(?:\s+edition)?|"
    r"1st(?:\s+edition)?|2nd(?:\s+edition)?|3rd(?:\s+edition)?|revised(?:\s+edition)?|updated(?:\s+edition)?|expanded(?:\s+edition)?|complete(?:\s+edition)?|definitive(?:\s+edition)?|illustrated(?:\s+edition)?|"
    r"gift(?:\s+edition)?|boxed(?:\s+set)?|set|omnibus(?:\s+edition)?|annotated(?:\s+edition)?|unabridged(?:\s+edition)?|abridged(?:\s+edition)?|preview|novel|edition|"
    r"vol\.?|volume|book\s+\d+|part\s+\d+|chapter\s+\d+|\d+)\s*[\)\]]"
)
#: Names that stand for no author.
BOGUS = r"calibre(-web)?|unknown|desconocido|epublibre|editor|traductor|chapter\s+(one|two|three|\d+)|cap[íi]tulo\s+(uno|dos|\d+)|author|autor|none|n/a|\?+"
#: Promotional ends of titles.
PROMOTION = r"\[retail\]|\(retail\)|\(v\d+(?:\.\d+)*\)|\(epub\)|\[epub\]|\[spanish edition\]|\[english edition\]|\(edici[óo]n en espa[ñn]ol\)|epublibre|[(\[]completo[)\]]|\.epub|\.pdf|\.mobi"
#: Words that stay small in a title, and acronyms that stay large.
SMALL = ("a an the and but or for nor on at to from by over in of with into onto el la los las un una unos unas y e ni o u de del al en con por para sin sobre tras").split()
ACRONYMS = "AI NASA MIT USA UK EU DNA RNA LLM GPT API FBI CIA KGB BBC CNN IBM SQL HTML CSS PDF HTTP HTTPS CPU GPU RAM ROM SSD HDD USB OS".split()
#: Periodicals as title pattern, author, sort key, rating, tags.
PERIODICALS = (
    (r"^the economist", "The Economist", "Economist, The", 7, ("Hemeroteca", "Periodicals", "News")),
    (r"^financial times", "Financial Times", "Financial Times", 7, ("Hemeroteca", "Periodicals", "News")),
    (r"^(spiegel online|der spiegel)", "Der Spiegel", "Spiegel, Der", 7, ("Hemeroteca", "Periodicals", "News")),
    (r"^the new yorker", "The New Yorker", "New Yorker, The", 7, ("Hemeroteca", "Periodicals", "Culture")),
    (r"^nature\b", "Nature", "Nature", 7, ("Hemeroteca", "Periodicals", "Science")),
    (r"^mit tr|^mit technology review", "MIT Technology Review", "MIT Technology Review", 7, ("Hemeroteca", "Periodicals", "Technology")),
)
COMPOUND = {"mario vargas llosa": "Vargas Llosa", "gabriel garcia marquez": "García Márquez"}
PARTICLES = ("von", "van", "de", "del", "della", "da", "di", "du", "des", "der", "den", "el", "al", "fitz", "mac", "mc")
PAIRS = ("de la", "de las", "de los", "van der")
#: ISO 639-1 to the codes of text recognition.
OCR_LANGUAGES = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ru": "rus", "ja": "jpn", "zh": "chi_sim"}


@lru_cache(4)
def _mapped(form: str, marks: bool, fold: bool) -> tuple[str, str]:
    """For `translate`: characters of the basic plane that a normal form turns into one other character, and those it leaves out.

    Hangul stays composed, and sequences of letter and mark aren't composed.
    """
    one, none = {}, []
    for p in range(0x80, 0x10000):
        if 0xAC00 <= p < 0xE000:
            continue
        c = unicodedata.normalize(form, chr(p))
        c = c if marks else "".join(x for x in c if not unicodedata.combining(x))
        c = c.casefold() if fold else c
        if len(c) == 1 and c != chr(p):
            one[chr(p)] = c
        elif not c:
            none.append(chr(p))
    return "".join(one) + "".join(none), "".join(one.values())


def _translated(c: Column, form: str, marks: bool, fold: bool) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *_mapped(form, marks, fold))).otherwise(c)


def folded(c: Column) -> Column:
    """Letters without accents, in their plain form; the ligatures that become several letters too."""
    t = _translated(c, "NFKD", False, False)
    long = t
    for a in "ĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳﬀﬁﬂﬃﬄﬅﬆ…™№":
        long = F.replace(long, F.lit(a), F.lit("".join(x for x in unicodedata.normalize("NFKD", a) if not unicodedata.combining(x))))
    return F.when(t.rlike("[ĲĳŉǄ-ǌǱ-ǳﬀ-ﬆ…™№]"), long).otherwise(t)


def plain_key(c: Column) -> Column:
    """Without accents and punctuation, single spaces, lower case; null gives ''."""
    return F.lower(F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")))


def verify_key(c: Column) -> Column:
    """N7 without edition tags in brackets."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), f"(?iU){EDITION_TAG}", ""), r"[^\p{L}\p{N}_]+", " ")))


def edition_tagged(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?iU){EDITION_TAG}"), F.lit(False))


def identity_key(c: Column) -> Column:
    """Compatibility form in folded case, words joined by one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(_translated(c, "NFKC", True, True)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def value_key(field: Column, value: Column) -> Column:
    """What of a value is compared: words of a text, sorted words of authors, sorted small codes of languages, else the value."""
    parts = lambda by, of: F.array_join(F.array_sort(F.filter(F.transform(F.split(value, by), of), lambda x: x != "")), "\n")
    return (
        F.when(field.isin("title", "publisher", "series", "edition_statement"), identity_key(value)).when(field == "authors", parts("&", identity_key))
        .when(field == "languages", parts("[;,]", lambda x: F.lower(F.trim(x)))).otherwise(value)
    )


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The ratio of matching blocks; null where a side is null. Pass null for pairs that are decided without it."""
    one = lru_cache(1 << 16)(lambda a, b: SequenceMatcher(None, a, b).ratio())
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(left, right)], dtype="float64")


def clean_author(c: Column) -> Column:
    """Trimmed of broken syntax; null for names that stand for no author."""
    t = F.regexp_replace(F.regexp_replace(c, r"^[ \t\n\r;/,\\'\"]+|[ \t\n\r;/,\\'\"]+$", ""), r"\s+", " ")
    t = F.trim(F.regexp_replace(t, "[;/]+$", ""))
    return F.when((t != "") & ~t.rlike(f"(?iU)^(?:{BOGUS})$"), t)


def split_authors(c: Column) -> Column:
    """Display names of the authors of a list with `;`, `&`, `and` or `et al`; names that stand for no author go."""
    chunks = F.split(F.coalesce(c, F.lit("")), r"(?iU)\s*(?:;|&|\band\b|\bet\s+al\.?)\s*")
    return F.transform(F.filter(F.transform(chunks, clean_author), lambda x: x.isNotNull()), author_display)


def promoted_title(c: Column) -> Column:
    """Without promotional ends; a title all in capitals takes title case, with acronyms and small words as they are."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), rf"(?iU)(\s*(?:{PROMOTION})\s*)+$", "")), r"\s+", " ")
    letters = F.regexp_replace(t, r"\P{L}", "")
    capital = (F.length(letters) > 3) & (F.upper(t) == t) & ~letters.rlike(r"[^\p{Lu}]")
    large, small = F.array(*[F.lit(x) for x in ACRONYMS]), F.array(*[F.lit(x) for x in SMALL])
    word = lambda w, i: (
        F.when(F.array_contains(large, F.upper(w)), F.upper(w)).when((i > 0) & F.array_contains(small, F.lower(w)), F.lower(w))
        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    )
    return F.when(capital, F.array_join(F.transform(F.split(t, " "), word), " ")).otherwise(t)


def image_type(c: Column) -> Column:
    """The kind of an image from its first bytes."""
    h = F.hex(F.substring(c, 1, 12))
    return (
        F.when(F.startswith(h, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(h, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 8) == "57454250"), "image/webp").when(F.startswith(h, F.lit("474946383761")) | F.startswith(h, F.lit("474946383961")), "image/gif")
    )


def allowed_url(c: Column, hosts: tuple[str, ...]) -> Column:
    """Https, no user, port 443 if any, and a host of the list."""
    part = lambda p: F.try_parse_url(c, F.lit(p))
    host = F.lower(part("HOST"))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & port.isin("", "443") & host.isin(*hosts), F.lit(False))


def _enlarged(c: Column, size: str) -> Column:
    """https, no curled edge, the raw zoom, and `size` where a size is given."""
    u = F.replace(F.replace(c, F.lit("http://"), F.lit("https://")), F.lit("&edge=curl"), F.lit(""))
    u = F.replace(F.replace(u, F.lit("edge=curl&"), F.lit("")), F.lit("edge=curl"), F.lit(""))
    zoomed = F.when(F.contains(u, F.lit("zoom=1")), F.replace(u, F.lit("zoom=1"), F.lit("zoom=0"))).when(F.contains(u, F.lit("zoom=5")), F.replace(u, F.lit("zoom=5"), F.lit("zoom=0")))
    u = zoomed.when(~F.contains(u, F.lit("zoom=")) & F.contains(u, F.lit("?")), F.concat(u, F.lit("&zoom=0"))).otherwise(u)
    return F.regexp_replace(u, r"fife=w\d+-h\d+", f"fife={size}")


def _front(volume: Column, size: str) -> Column:
    return F.when(volume != "", F.concat(F.lit("https://books.google.com/books/publisher/content/images/frontcover/"), volume, F.lit(f"?fife={size}")))


def volume_cover_url(c: Column, volume: Column) -> Column:
    """N20 as the provider has it: a thumbnail's address at full zoom, else that of the volume's front cover; null without both."""
    return F.when(c != "", _enlarged(c, "w1000-h1500")).otherwise(_front(volume, "w1000-h1500"))


def large_cover_url(c: Column, volume: Column | None = None) -> Column:
    """N20 as the consensus has it: a size is always asked for."""
    u = _enlarged(c, "w1600-h2400")
    more = F.when(F.contains(u, F.lit("fife=")), u).otherwise(F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("fife=w1600-h2400")))
    return F.when(c != "", more).otherwise(_front(F.lit(None).cast("string") if volume is None else volume, "w1600-h2400"))


def isbn_cover_url(isbn13: Column, cover: Column | None = None) -> Column:
    """By the number of a cover, else by ISBN-13; never the empty default picture."""
    by_isbn = F.concat(F.lit("https://covers.openlibrary.org/b/isbn/"), isbn13, F.lit("-L.jpg?default=false"))
    return by_isbn if cover is None else F.when(cover != 0, F.concat(F.lit("https://covers.openlibrary.org/b/id/"), cover.cast("string"), F.lit("-L.jpg?default=false"))).otherwise(by_isbn)


def shop_cover_url(number: Column) -> Column:
    """By a shop's number or an ISBN, letters and digits in upper case."""
    return F.concat(F.lit("https://images-na.ssl-images-amazon.com/images/P/"), F.upper(F.regexp_replace(number, "[^0-9A-Za-z]", "")), F.lit(".01._SL1600_.jpg"))


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def duplicate_key(c: Column) -> Column:
    """Letters, digits, + and # in lower case, leading articles gone; null and empty give ''."""
    plain = F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9\s+#]", " ")))
    return spaced(F.regexp_replace(plain, rf"^((?:{KEY_ARTICLES})\s+)+", ""))


def clean_title(c: Column) -> Column:
    """Without extensions, distributor marks, edge punctuation and empty brackets."""
    t = F.trim(F.coalesce(c, F.lit("")))
    for e in EXTENSIONS:
        t = F.trim(F.regexp_replace(t, rf"(?iu)\.{e}$", ""))
    for p in JUNK:
        t = F.trim(F.regexp_replace(t, f"(?iU){p}", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"^[\s\-_:.]+|[\s\-_:.]+$", ""), r"\s+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\(\s*\)|\[\s*\]", "")), r"\s+", " ")


def _parted(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), F.split(c, ":", 2)).when(F.contains(c, F.lit(" - ")), F.split(c, " - ", 2)).otherwise(F.array(c))


def main_title(c: Column) -> Column:
    """What stands before the first colon, or else before the first ` - `."""
    return F.when(F.size(_parted(c)) > 1, F.trim(F.get(_parted(c), F.lit(0)))).otherwise(c)


def subtitle(c: Column) -> Column:
    return F.nullif(F.trim(F.get(_parted(c), F.lit(1))), F.lit(""))


def title_sort(c: Column) -> Column:
    """A leading article moves behind a comma."""
    t = F.trim(F.coalesce(c, F.lit("")))
    out = t
    for a in reversed(SORT_ARTICLES):
        moved = F.concat(F.trim(F.substring(t, F.lit(len(a) + 1), F.length(t))), F.lit(", "), F.regexp_replace(F.trim(F.substring(t, 1, len(a))), "'$", ""))
        out = F.when(F.startswith(F.lower(t), F.lit(a)), moved).otherwise(out)
    return out


def author_display(c: Column) -> Column:
    """N14: 'Last, First' to 'First Last', with corporate names, saints and popes."""
    n = F.trim(F.coalesce(c, F.lit("")))
    last, first = F.trim(F.get(F.split(n, ",", 2), F.lit(0))), F.trim(F.get(F.split(n, ",", 2), F.lit(1)))
    key = F.lower(first)
    turned = (
        F.when(key.isin("saint", "st."), F.concat(F.lit("Saint "), last)).when(key.isin("pope", "papa"), F.concat(F.lit("Pope "), last))
        .when(key.isin("the", "der"), F.concat(F.initcap(first), F.lit(" "), last)).otherwise(F.concat(first, F.lit(" "), last))
    )
    return F.when(F.contains(n, F.lit(",")), turned).otherwise(F.regexp_replace(n, r"\s+", " "))


def author_sort(c: Column) -> Column:
    """The sort key of a name in direct order."""
    n = F.trim(F.coalesce(c, F.lit("")))
    words = F.split(spaced(n), " ")
    count = F.size(words)
    tail = lambda k: F.array_join(F.slice(words, count - k + 1, F.lit(k)), " ")
    head = lambda k: F.array_join(F.slice(words, F.lit(1), F.greatest(count - k, F.lit(0))), " ")
    behind = lambda k: F.concat(tail(k), F.lit(", "), head(k))
    two = F.lower(F.array_join(F.slice(words, F.greatest(count - 2, F.lit(1)), F.lit(2)), " "))
    one = F.lower(F.get(words, count - 2))
    out = F.when(n == "", F.lit(""))
    for name, key in CORPORATE.items():
        out = out.when(F.lower(n) == name, F.lit(key))
    out = out.when(F.contains(n, F.lit(",")), n)
    out = out.when(n.rlike(r"^(Saint|St\.|San) "), F.concat(F.regexp_replace(n, r"^(Saint|St\.|San)\s+", ""), F.lit(", Saint")))
    out = out.when(n.rlike(r"^(Pope|Papa) "), F.concat(F.regexp_replace(n, r"^(Pope|Papa)\s+", ""), F.lit(", Pope")))
    out = out.when(count == 1, n)
    for name, surname in COMPOUND.items():
        out = out.when(F.lower(spaced(folded(n))) == name, F.concat(F.lit(f"{surname}, "), head(len(surname.split()))))
    return out.when((count >= 4) & two.isin(*PAIRS), behind(3)).when((count >= 3) & one.isin(*PARTICLES), behind(2)).otherwise(behind(1))


def authors_joined(c: Column, key) -> Column:
    """The names of an '&'-separated string, each through `key`, joined again."""
    return F.array_join(F.transform(F.filter(F.split(c, "&"), lambda x: F.trim(x) != ""), key), " & ")


def transliterated(c: Column) -> Column:
    """Cyrillic to Latin, lower case."""
    t = F.lower(c)
    for a, b in {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.translate(t, "абвгдеёзийклмнопрстуфыэъь", "abvgdeeziyklmnoprstufye")


def ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance by the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the common tokens and the common tokens with either rest."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both, only_x, only_y = (F.array_join(F.array_sort(s), " ") for s in (F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)))
    one, two = F.trim(F.concat_ws(" ", both, only_x)), F.trim(F.concat_ws(" ", both, only_y))
    return F.greatest(ratio(both, one), ratio(both, two), ratio(one, two), ratio(a, b))


def number(c: Column) -> Column:
    """A string or number as double, null where it isn't one."""
    return F.trim(c.cast("string")).try_cast("double")


def quality(c: Column) -> Column:
    """Low if empty, over a tenth unprintable (controls, formats, separators but the space), or under five words."""
    unprintable = F.length(F.regexp_replace(c, r"[^\p{C}\p{Zl}\p{Zp}\p{Zs}]|[ \n\t]", ""))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "low").when(unprintable / F.length(c) > 0.1, "low").when(words < 5, "low").otherwise("high")


#: Formats that an inventory counts by name.
FORMATS = ("AZW", "AZW3", "CBR", "CBZ", "DJVU", "DOCX", "EPUB", "FB2", "HTM", "HTML", "KFX", "LIT", "LRF", "MOBI", "ODT", "PDB", "PDF", "PRC", "RTF", "TCR", "TPZ", "TXT")


def format_bucket(c: Column) -> Column:
    t = format_token(c)
    return F.when(t.isin(*FORMATS), t).otherwise("OTHER")


def format_token(c: Column) -> Column:
    """A suffix or token in upper case, UNKNOWN if it isn't 1 to 16 letters or digits."""
    t = F.upper(F.regexp_replace(F.trim(c), r"^.*\.", ""))
    return F.when(t.rlike("^[A-Z0-9]{1,16}$"), t).otherwise("UNKNOWN")


def ocr_language(c: Column) -> Column:
    out = F.lit("eng")
    for a, b in OCR_LANGUAGES.items():
        out = F.when(c == a, b).otherwise(out)
    return out


def page_source(path: Column, index: Column) -> Column:
    """What kind of page a path is."""
    p = F.lower(path)
    return F.when(p.rlike("copyright|colophon"), "copyright_page").when(F.contains(p, F.lit("title")) | (index == 0), "title_page").otherwise("body")
