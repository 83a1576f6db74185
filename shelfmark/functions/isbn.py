"""ISBN checks as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that people type to fill the field.
DUMMIES = ("1234567890", "0123456789", "9876543210", "0987654321", "1234567890123", "9781234567890", "9780000000000")


def cleaned(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))


def _weighted(c: Column, weights: list[int]) -> Column:
    """The weighted sum of leading digits, X as ten; callers have checked the shape.

    A fold over the characters names `c` once, where a term for each digit would
    repeat its whole expression.
    """
    digit = lambda x: F.when(x == "X", 10).otherwise(F.ascii(x) - 48)
    terms = F.zip_with(F.split(c, ""), F.array(*[F.lit(w) for w in weights]), lambda x, w: F.coalesce(digit(x) * w, F.lit(0)))
    return F.aggregate(terms, F.lit(0), lambda total, x: total + x)


def isbn10_valid(c: Column) -> Column:
    """Weights 10 to 1, modulo 11; X counts ten and stands last only."""
    c = cleaned(c)
    return F.coalesce(F.when(c.rlike("^[0-9]{9}[0-9X]$"), _weighted(c, list(range(10, 0, -1))) % 11 == 0), F.lit(False))


def isbn13_valid(c: Column) -> Column:
    """Weights 1 and 3 in turn, modulo 10."""
    c = cleaned(c)
    return F.coalesce(F.when(c.rlike("^[0-9]{13}$"), _weighted(c, [1, 3] * 6 + [1]) % 10 == 0), F.lit(False))


def turned(c: Column) -> Column:
    """The first nine digits of an ISBN-10 with prefix 978 and a new check digit."""
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    return F.concat(body, F.pmod(10 - _weighted(body, [1, 3] * 6) % 10, F.lit(10)).cast("string"))


def canonical13(c: Column) -> Column:
    """A valid ISBN-13 as it is, a valid ISBN-10 with prefix 978 and a new check digit, else null."""
    c = cleaned(c)
    return F.when(isbn13_valid(c), c).when(isbn10_valid(c), turned(c))


def plausible(c: Column) -> Column:
    """Length 10 or 13, more than one distinct character, no dummy, X in the tenth place of ten only."""
    c = F.regexp_replace(F.upper(c), "[^0-9X]", "")
    shape = c.rlike("^([0-9]{9}[0-9X]|[0-9]{13})$") & (F.size(F.array_distinct(F.split(c, ""))) > 1)
    return F.coalesce(shape & ~c.isin(*DUMMIES), F.lit(False))


def state(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(isbn10_valid(c) | isbn13_valid(c), "valid").otherwise("invalid")


#: Fixed value: what an ISBN looks like in running text.
SHAPE = r"(?:ISBN(?:-1[03])?:?\s*)?((?:\d[ |-]?){9,13}[\d|X])"


def first_shaped(text: Column) -> Column:
    """The first ISBN-shaped string of 10 or 13 characters without spaces and hyphens, unchecked."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){SHAPE}"), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s-]", ""))
    return F.get(F.filter(found, lambda x: F.length(x).isin(10, 13)), F.lit(0))
