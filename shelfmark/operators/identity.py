"""Identity resolution over format and evidence rows (R1-R11): who says so, and how many independent roots.

Values are compared by their N18 key, computed once a row. Every test is an
aggregate by book; the ladder is one `case` over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import isbn, text

INTERNAL = ("content_native", "ocr_consensus")
EXTERNAL = ("provider_structured", "official_page", "national_library")
PROMOTABLE = ("embedded_metadata", *INTERNAL, *EXTERNAL)
OFFICIAL = ("official_page", "national_library")
CORE = ("title", "authors", "languages")
TIERS = {
    "format_manifestation_conflict": "C", "incomplete_format_evidence": "B", "missing_manifestation_identifier": "B", "missing_internal_manifestation_confirmation": "B",
    "missing_external_manifestation_confirmation": "B", "format_expression_conflict": "C", "incomplete_internal_core_evidence": "B", "external_expression_conflict": "C",
    "missing_external_core_confirmation": "B", "confirmed": "A",
}


def _any(c: Column) -> Column:
    return F.coalesce(F.max(c), F.lit(False))


def confirmations(evidence: DataFrame) -> DataFrame:
    """Whether an internal row with the same value, and an external row, confirm the identifier of each book, both authoritative."""
    own = evidence.where("field = 'identifiers'")
    sure = F.col("authoritative") & (F.col("value") == F.col("manifestation_isbn"))
    return own.groupBy("book_id").agg(_any(sure & F.col("source_kind").isin(*INTERNAL)).alias("internal"), _any(sure & F.col("source_kind").isin(*EXTERNAL)).alias("external"))


def format_facts(formats: DataFrame) -> DataFrame:
    """By book: formats, readable ones, their valid ISBNs, core conflict and completeness, and the first format's core keys.

    `formats`: book_id, format, status, isbn, title, authors, languages (lists as strings).
    """
    readable = F.col("status") == "readable"
    keys = {f: text.value_key(F.lit(f), F.col(f)) for f in CORE}
    rows = formats.select("book_id", "format", readable.alias("readable"), F.when(readable, isbn.canonical13(F.col("isbn"))).alias("id"), *[F.when(readable & (F.trim(F.col(f)) != ""), k).alias(f) for f, k in keys.items()])
    return rows.groupBy("book_id").agg(
        F.count("*").alias("n_formats"), F.count_if("readable").alias("n_readable"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("id"),
        F.greatest(*[F.countDistinct(f) for f in CORE]).alias("n_values"),
        F.coalesce(F.min(F.when(F.col("readable"), F.least(*[F.col(f).isNotNull() for f in CORE]))), F.lit(False)).alias("complete"),
        F.min_by(F.when(F.col("readable"), F.struct(*CORE)), F.when(F.col("readable"), F.col("format"))).alias("core"),
    )


def _exact_roots(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """External roots with an authoritative identifier row of the book's own identifier."""
    rows = evidence.where(F.col("authoritative") & F.col("source_kind").isin(*EXTERNAL) & (F.col("field") == "identifiers"))
    return rows.join(ids, "book_id").where(F.col("manifestation_isbn") == F.col("id")).select("book_id", "independence_root").distinct()


def root_tests(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """By book and exact root: whether an external row disagrees with the core, and whether all three fields agree."""
    core = evidence.where(F.col("authoritative") & F.col("field").isin(*CORE)).withColumn("key", text.value_key(F.col("field"), F.col("value")))
    told = core.join(_exact_roots(evidence, facts.select("book_id", "id")), ["book_id", "independence_root"]).join(facts.select("book_id", "core"), "book_id")
    same = F.coalesce(F.col("key") == F.coalesce(*[F.when(F.col("field") == f, F.col("core")[f]) for f in CORE]), F.lit(False))
    return told.groupBy("book_id", "independence_root").agg(
        _any(~same & F.col("source_kind").isin(*EXTERNAL)).alias("disagrees"), ((F.countDistinct(F.when(same, F.col("field"))) == len(CORE)) & F.min(same)).alias("agrees")
    )


def root_matches(evidence: DataFrame, formats: DataFrame) -> DataFrame:
    """Roots that confirm title, authors and languages of the book's first readable format exactly."""
    return root_tests(evidence, format_facts(formats)).where("agrees").select("book_id", "independence_root")


def resolved(evidence: DataFrame, formats: DataFrame) -> DataFrame:
    """The first failing test decides tier, reason and state; `id` is the book's identifier.

    Evidence meets the facts of the formats once, by book; what it says is gathered by root and then by book, where the rows already lie.
    """
    facts = format_facts(formats)
    rows = evidence.join(facts.select("book_id", "id", "core"), "book_id", "left")
    field, kind = F.col("field"), F.col("source_kind")
    own = F.col("authoritative") & (field == "identifiers") & (F.col("manifestation_isbn") == F.col("id"))
    core = F.col("authoritative") & field.isin(*CORE)
    rows = rows.withColumn("same", F.when(core, F.coalesce(F.when(core, text.value_key(field, F.col("value"))) == F.coalesce(*[F.when(field == f, F.col("core")[f]) for f in CORE]), F.lit(False))))
    by_root = rows.groupBy("book_id", "independence_root").agg(
        _any(own & kind.isin(*INTERNAL) & (F.col("value") == F.col("id"))).alias("internal"), _any(own & kind.isin(*EXTERNAL)).alias("external"), _any(core & ~F.col("same") & kind.isin(*EXTERNAL)).alias("disagrees"),
        F.coalesce(F.min("same"), F.lit(False)).alias("agrees"), *[_any(F.col("same") & (field == f)).alias(f) for f in CORE],
    )
    sure = by_root.groupBy("book_id").agg(F.max("internal").alias("internal"), F.max("external").alias("external"), F.max(F.col("external") & F.col("disagrees")).alias("disagrees"), F.max(F.col("external") & F.col("agrees") & F.col(CORE[0]) & F.col(CORE[1]) & F.col(CORE[2])).alias("agrees"))
    told = facts.join(sure, "book_id", "full_outer")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("n_ids") > 1, "format_manifestation_conflict").when(F.col("n_readable") < F.col("n_formats"), "incomplete_format_evidence").when(F.col("id").isNull(), "missing_manifestation_identifier")
        .when(no("internal"), "missing_internal_manifestation_confirmation").when(no("external"), "missing_external_manifestation_confirmation").when(F.col("n_values") > 1, "format_expression_conflict")
        .when(no("complete"), "incomplete_internal_core_evidence").when(~no("disagrees"), "external_expression_conflict").when(no("agrees"), "missing_external_core_confirmation").otherwise("confirmed")
    )
    out = told.select("book_id", F.when(F.col("n_ids") == 1, F.col("id")).alias("id"), reason.alias("reason"))
    tier = F.when(F.col("reason").isin(*[r for r, t in TIERS.items() if t == "C"]), "C").when(F.col("reason") == "confirmed", "A").otherwise("B")
    return out.withColumn("tier", tier).withColumn("state", F.when(F.col("tier") == "A", "shadowed").when(F.col("tier") == "C", "deferred").otherwise("review"))


def tiers(evidence: DataFrame, formats: DataFrame) -> DataFrame:
    """Tier, reason and state of every book."""
    return resolved(evidence, formats).select("book_id", "tier", "reason", "state")


def field_consensus(evidence: DataFrame) -> DataFrame:
    """One value, two independent roots, one of them internal or official: auto; everything else: review."""
    good = evidence.where(F.col("authoritative") & F.col("source_kind").isin(*PROMOTABLE)).withColumn("key", text.value_key(F.col("field"), F.col("value")))
    by = good.groupBy("book_id", "field").agg(
        F.countDistinct("key").alias("n_values"), F.countDistinct("independence_root").alias("n_roots"), F.max(F.col("source_kind").isin("embedded_metadata", *INTERNAL, *OFFICIAL)).alias("sure"), F.min("key").alias("value"), F.min("value").alias("told")
    )
    return by.select("book_id", "field", "n_values", "n_roots", F.when(F.col("n_values") == 1, F.col("value")).alias("value"), F.when((F.col("n_values") == 1) & (F.col("n_roots") >= 2) & F.col("sure"), "auto").otherwise("review").alias("status"))


def decisions(evidence: DataFrame, formats: DataFrame, current: DataFrame) -> DataFrame:
    """A row for each book and field with evidence: status, resolved value, and the patch value of `auto` rows.

    Under tier A a field is judged on its promotable rows of the book's own identifier; C blocks and B sends to
    review. `current`: book_id, field, value. An identifier patch names its namespace alone, so
    unobserved namespaces stay when it is merged into the record.
    """
    book = resolved(evidence, formats).select("book_id", "id", "tier")
    rows = evidence.join(book, "book_id").withColumn("key", text.value_key(F.col("field"), F.col("value")))
    good = F.col("authoritative") & F.col("source_kind").isin(*PROMOTABLE) & F.coalesce(F.col("manifestation_isbn") == F.col("id"), F.lit(False))
    by = rows.groupBy("book_id", "field").agg(
        F.first("tier").alias("tier"), F.countDistinct(F.when(good, F.col("key"))).alias("n_values"), F.countDistinct(F.when(good, F.col("independence_root"))).alias("n_roots"),
        _any(good & F.col("source_kind").isin("embedded_metadata", *INTERNAL, *OFFICIAL)).alias("sure"), F.min(F.when(good, F.col("key"))).alias("key"), F.min(F.when(good, F.col("value"))).alias("told"),
    )
    now = current.select("book_id", "field", text.value_key(F.col("field"), F.col("value")).alias("now"))
    status = (
        F.when(F.col("tier") == "C", "blocked").when((F.col("tier") == "B") | (F.col("n_values") != 1) | (F.col("n_roots") < 2) | ~F.col("sure"), "review")
        .when(F.coalesce(F.col("key") == F.col("now"), F.lit(False)), "unchanged").otherwise("auto")
    )
    out = by.join(now, ["book_id", "field"], "left").withColumn("status", status)
    return out.select("book_id", "field", "tier", "status", F.when((F.col("tier") == "A") & (F.col("n_values") == 1), F.col("key")).alias("resolved"), F.when(F.col("status") == "auto", F.col("told")).alias("patch"))


def ocr_consensus(readings: DataFrame) -> DataFrame:
    """By file: the ISBN on which all engines agree, each having read that one alone; two engines make it authoritative.

    `readings`: file_id, engine, isbn.
    """
    per = readings.withColumn("id", isbn.canonical13(F.col("isbn"))).groupBy("file_id", "engine").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    by = per.groupBy("file_id").agg(F.count("*").alias("n_engines"), F.max("n").alias("most"), F.min("n").alias("least"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("id"))
    agreed = (F.col("most") == 1) & (F.col("least") == 1) & (F.col("n_ids") == 1)
    return by.select("file_id", "n_engines", F.when(agreed, F.col("id")).alias("isbn"), (agreed & (F.col("n_engines") >= 2)).alias("authoritative"))


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """A stable id from root and field; `clash` where one id has several contents; repeated rows are one."""
    made = F.substring(F.sha2(F.concat_ws("|", "book_id", "independence_root", "field"), 256), 1, 20)
    by = evidence.select(made.alias("evidence_id"), F.sha2(F.to_json(F.struct("value", "source_kind", "authoritative")), 256).alias("content")).groupBy("evidence_id")
    return by.agg(F.count("*").alias("n_rows"), (F.countDistinct("content") > 1).alias("clash"))


def sealed(rows: DataFrame, *columns: str) -> DataFrame:
    """`seal`, SHA-256 over the canonical text of the columns."""
    return rows.withColumn("seal", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256))


def broken_seals(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose stored seal isn't that of their columns."""
    again = sealed(rows.withColumnRenamed("seal", "stored"), *columns)
    return again.where(~F.col("stored").eqNullSafe(F.col("seal"))).drop("seal").withColumnRenamed("stored", "seal")


def changed_sources(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest differs between two snapshots: added, removed or changed."""
    both = before.select(F.col(key), F.col(digest).alias("old")).join(after.select(F.col(key), F.col(digest).alias("new")), key, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, kind.alias("change"))
