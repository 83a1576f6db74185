"""License scans with DataFrame functions only: an exact set-similarity join.

A block is a window of `BLOCK` words, one every `STRIDE` words, so every run of up
to `STRIDE` words lies whole in some block. A template is a set of at most `STRIDE`
words. The join finds every block B and template T with |B ∩ T| >= ceil(t * |T|):

* tokens of the templates are ordered by their document frequency over the
  whole corpus, rarest first (the vocabulary of the templates bounds that table);
* prefix filter: a block that reaches k of the m tokens of a template holds one
  of its m - k + 1 rarest, so only those meet in the equi-join;
* positional filter: the pair counts at the first shared token only, and from
  position p at most m - p tokens can still be shared;
* length filter: the block needs k distinct words;
* the intersection is then counted exactly.

A block that meets the threshold is labelled unless a rule of the template's own
says no: notices that differ in one word name that word as needed or as barred,
and a template of under `ORDERED` distinct words must stand in the block word for
word, since so few words meet by chance in any order.

Documents without any prefix token never leave the scan. The template side is
a fixed table (`templates`), so its broadcast doesn't grow with the data. The
documents are read three times: for the frequencies, for the join, for the base.

Base rule: places where a phrase's words stand consecutively.

Defined results: a null text counts as empty and has no words, no places and
score 0; repeated rows give repeated rows; rows that share a doc_id have the labels
of their own text each; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm._text import documents

#: Words, and what stands between them; splitting is several times faster than extracting.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A template of fewer distinct words is matched in order.
ORDERED = 7

#: Opening sentences of public license notices and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

#: Words that a label's notice needs, and words that say it is another notice.
NEEDED = {"lgpl": ("lesser", "library"), "cc-by-nc": ("nc",)}
BARRED = {"gpl": ("lesser",), "cc-by": ("noncommercial", "noderivatives", "sharealike")}


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def places(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words in an array of words."""
    parts = phrase.split()
    return F.filter(
        F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)]),
    )


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))


def prefixes(spark: SparkSession, words: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(token, template, label, tokens, need, size, position, earlier) for each prefix token of each template.

    `earlier`: the template's tokens before this one in the global order.
    """
    rows = [(i, label, sorted(set(text.split()))) for i, (label, text) in enumerate(templates)]
    vocabulary = sorted({t for _, _, tokens in rows for t in tokens})
    counts = words.select(F.explode(F.array_intersect("words", _literal(vocabulary))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = spark.createDataFrame(counts.collect(), "token string, n long")  # at most the templates' vocabulary
    sides = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), _literal(tokens).alias("tokens"), F.lit(-int(-threshold * len(tokens) // 1)).alias("need")) for i, label, tokens in rows])))
    ordered = (
        sides.select("template", "label", "need", F.explode("tokens").alias("token")).join(counts, "token", "left")
        .groupBy("template", "label", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("order"))
        .select("template", "label", "need", F.col("order.token").alias("tokens"))
    )
    return (
        ordered.select("*", F.posexplode("tokens").alias("position", "token"))
        .where(F.col("position") <= F.size("tokens") - F.col("need"))
        .withColumn("earlier", F.slice("tokens", F.lit(1), F.col("position")))
        .withColumn("size", F.size("tokens"))
    )


def matches(words: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (doc_id, t, label, start, containment) of a block that meets the threshold and the label's rules; `words` has doc_id, t and words."""
    spark = words.sparkSession
    side = prefixes(spark, words, templates, threshold)
    #: at most the tokens of the fixed templates
    rare = sorted({r["token"] for r in side.select("token").distinct().collect()})
    run = F.slice("words", F.col("start") + 1, F.lit(BLOCK))
    text = F.concat(F.lit(" "), F.array_join("run", " "), F.lit(" "))
    ruled = F.lit(True)
    for label, need in NEEDED.items():
        ruled &= (F.col("label") != label) | reduce(lambda a, b: a & b, [F.array_contains("block", w) for w in need])
    for label, bar in BARRED.items():
        ruled &= (F.col("label") != label) | ~F.arrays_overlap("block", _literal(list(bar)))
    for label, phrase in templates:
        if len(set(phrase.split())) < ORDERED:
            ruled &= (F.col("label") != label) | F.contains(text, F.lit(f" {phrase} "))
    return (
        words.withColumn("token", F.explode(F.array_intersect("words", _literal(rare))))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRIDE))))
        .select("doc_id", "t", "token", "start", run.alias("run"))
        .withColumn("block", F.array_distinct("run"))
        .where(F.array_contains("block", F.col("token")))
        .join(F.broadcast(side), "token")
        .where((F.size("block") >= F.col("need")) & (F.col("size") - F.col("position") >= F.col("need")) & ~F.arrays_overlap("block", "earlier"))
        .withColumn("shared", F.size(F.array_intersect("block", "tokens")))
        .where((F.col("shared") >= F.col("need")) & ruled)
        .select("doc_id", "t", "label", "start", (F.col("shared") / F.col("size")).alias("containment"))
    )


def scan(df: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The contract of op1: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = documents(df, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("t"), F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BETWEEN), "").alias("words")
    )
    #: Every phrase holds one of these words; the few texts that do alone have their words compared.
    likely = F.arrays_overlap("words", _literal(sorted({max(p.split(), key=len) for p in PHRASES})))
    found = F.concat(*[_labelled(places(F.col("words"), p), label) for p, label in PHRASES.items()])
    base = words.select("doc_id", "t", F.size("words").cast("long").alias("n_words"), F.when(likely, found).alias("found"))
    none = F.array().cast("array<string>")
    by_doc = (
        matches(words, templates, threshold).groupBy("doc_id", "t").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        .select(F.col("doc_id").alias("id"), F.col("t").alias("of"), "more", "best")
    )
    own = F.coalesce(F.array_sort(F.array_distinct("found.label")), none)
    return base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.array_size("found"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("found.at").cast("long").alias("first_word"),
        F.array_max("found.at").cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.coalesce(F.array_size("found"), F.lit(0)) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL, by comparing every block with every template."""
    values = ", ".join(f"('{label}', {sorted(set(text.split()))}, {-int(-threshold * len(set(text.split())) // 1)})" for label, text in templates)
    phrase = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_contains(words, '{p.split()[0]}')) WHERE "
        + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    rules = [f"(label <> '{label}' OR len(list_intersect(block, {list(need)})) = {len(need)})" for label, need in NEEDED.items()]
    rules += [f"(label <> '{label}' OR len(list_intersect(block, {list(bar)})) = 0)" for label, bar in BARRED.items()]
    rules += [f"(label <> '{label}' OR contains(' ' || array_to_string(run, ' ') || ' ', ' {text} '))" for label, text in templates if len(set(text.split())) < ORDERED]
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
t(label, tokens, need) AS (VALUES {values}),
hits AS ({phrase}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS own FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, words[s + 1 : s + {BLOCK}] AS run, list_distinct(words[s + 1 : s + {BLOCK}]) AS block FROM (SELECT doc_id, words, unnest(range(0, len(words), {STRIDE})) AS s FROM w)),
pairs AS (SELECT doc_id, label, run, block, len(list_intersect(block, tokens)) AS shared, len(tokens) AS size, need FROM blocks, t),
more AS (SELECT doc_id, list(DISTINCT label) AS more, max(shared / size) AS best FROM pairs WHERE shared >= need AND {' AND '.join(rules)} GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0E0 ELSE coalesce(best, 0.0E0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""
