"""Cover scores from measured statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that no clean cover shows.
WORDS = ("z-library", "libgen", "welib.org", "oceanofpdf", "bestseller", "now a netflix", "new york times bestseller")


def quality(covers: DataFrame) -> DataFrame:
    """CQS of 0 to 100, tier and whether the cover needs work."""
    w, h = F.col("width"), F.col("height")
    micro, low = (w < 100) | (h < 150), (w < 400) | (h < 600)
    ratio = h / w
    plain = F.when(low, 10.0 * F.least(w / 400, h / 600)).otherwise(15.0 + 10.0 * F.least(F.lit(1.0), w.cast("long") * h / 2160000))
    size = F.when(micro, F.lit(2.0)).otherwise(F.least(F.lit(25.0), F.when(ratio < 1.1, F.greatest(F.lit(5.0), plain - 8)).when(ratio > 2.0, F.greatest(F.lit(5.0), plain - 5)).otherwise(plain)))
    g, s, e = F.col("avg_grad"), F.col("std_dev"), F.col("entropy")
    sharp = F.when(g < 4, 5.0).when(g < 8, 14.0).otherwise(F.least(F.lit(25.0), 15.0 + g - 8))
    contrast = F.when(s < 20, 6.0).otherwise(F.least(F.lit(25.0), s / 75 * 25))
    bad = sum((F.contains(F.lower(F.coalesce("ocr_text", F.lit(""))), F.lit(x)).cast("int") for x in WORDS), F.lit(0))
    clean = F.greatest(F.lit(0.0), 25.0 - 8.0 * bad)
    flag = lambda c: c.cast("int")
    penalties = flag(~micro & low) + flag(~micro & ((ratio < 1.1) | (ratio > 2.0))) + flag(g < 8) + flag(s < 20) + flag(e < 1.5) + bad
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(size + sharp + contrast + clean - 5.0 * penalties)))
    bomb = (w.cast("long") * h > 25_000_000) | (F.col("size_bytes") > 25_000_000)
    score = F.when(bomb, F.lit(0)).when(micro, F.least(total, F.lit(35))).otherwise(total)
    out = covers.select("cover_id", score.cast("int").alias("cqs"), (micro | bomb).alias("fatal"))
    tier = F.when(F.col("cqs") >= 80, "A").when(F.col("cqs") >= 65, "B").when(F.col("cqs") >= 45, "C").otherwise("D")
    return out.select("cover_id", "cqs", tier.alias("tier"), ((F.col("cqs") < 60) | F.col("fatal")).alias("actionable"))


def oversize(covers: DataFrame) -> DataFrame:
    """P10: more than 30 million pixels or 10 MB."""
    return covers.where((F.col("width").cast("long") * F.col("height") > 30000000) | (F.col("size_bytes") > 10000000)).select("cover_id")


def histogram_facts(histograms: DataFrame) -> DataFrame:
    """Entropy in bits and contrast score of each cover from its grey histogram (cover_id, bin, n); one aggregation."""
    n, b = F.col("n").cast("double"), F.col("bin").cast("double")
    by = histograms.where("n > 0").groupBy("cover_id").agg(F.sum(n).alias("t"), F.sum(n * F.log2(n)).alias("e"), F.sum(n * b).alias("m"), F.sum(n * b * b).alias("q"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("t") - F.pow(F.col("m") / F.col("t"), 2)))
    return by.select("cover_id", F.round(F.log2("t") - F.col("e") / F.col("t"), 6).alias("entropy"), F.round(F.when(spread < 20, 6.0).otherwise(F.least(F.lit(25.0), spread / 75 * 25)), 6).alias("contrast"))


#: Words of a cover that a program made, and of a page inside a book.
MADE, INSIDE = ("generated by calibre", "calibre quick cover"), ("contents", "chapter", "preface", "index", "all rights reserved", "printed in")


def spurious(covers: DataFrame) -> DataFrame:
    """Covers that are a program's template, a blank canvas or a page of text, in this order, with confidence."""
    says = lambda words: F.lower(F.coalesce("ocr_text", F.lit(""))).rlike("|".join(words))
    inside = (F.col("white_ratio") > 0.80) & (F.col("dark_ratio") > 0.015) & (F.col("dark_ratio") < 0.22)
    kind = F.when(says(MADE), "calibre_default_template").when(F.col("dominant_ratio") > 0.98, "blank_canvas").when(inside, "interior_page_scan")
    sure = F.when(says(MADE), 0.98).when(F.col("dominant_ratio") > 0.98, F.col("dominant_ratio")).when(inside & says(INSIDE), 0.98).when(inside & F.col("entropy").between(1.2, 3.5), 0.92).when(inside, 0.85)
    return covers.select("cover_id", kind.alias("defect"), sure.alias("confidence")).where("defect is not null")


def forensics(facts: DataFrame, her: float = 6.5, acf: float = 0.28) -> DataFrame:
    """What the line spectrum tells of a cover: reading page, placeholder, distorted or small. `facts`: her, acf, folio, mono, entropy, width, height."""
    ratio = F.col("height") / F.col("width")
    lines, regular = F.col("her") >= her, F.col("acf") >= acf
    paragraph = (F.col("acf") >= acf * 1.3) & (F.col("her") >= 3.0) & (F.col("entropy") < 4.0)
    reason = (
        F.when(lines & regular, "dense_text_reading_page").when(lines & F.col("folio"), "marginal_folio_with_dense_lines").when(paragraph, "periodic_paragraph_lines").when(F.col("mono"), "monochrome_or_blank_placeholder")
        .when((ratio < 1.0) | (ratio > 2.2), "distorted_aspect_ratio").when((F.col("width") < 300) | (F.col("height") < 400), "critically_low_resolution")
    )
    sure = (
        F.when(lines & regular, F.least(F.lit(0.99), 0.70 + F.col("her") / 20 + F.col("acf"))).when(lines & F.col("folio"), 0.95).when(paragraph, 0.90).when(F.col("mono"), 0.95).when((ratio < 1.0) | (ratio > 2.2), 0.85)
        .when((F.col("width") < 300) | (F.col("height") < 400), 0.80)
    )
    return facts.select("cover_id", reason.alias("reason"), F.round(sure, 6).alias("confidence"))


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files to measure again: not in the cache with the same size and time."""
    return files.join(cache, [files["cover_id"].eqNullSafe(cache["cover_id"]), files["size_bytes"] == cache["size_bytes"], files["mtime"] == cache["mtime"]], "left_anti")


def upserted(cache: DataFrame, measured: DataFrame) -> DataFrame:
    """The cache with measured rows in place of older ones."""
    return cache.join(measured.select("cover_id"), "cover_id", "left_anti").unionByName(measured)
