"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import alignment, bpe, hamming, kneser_ney, language, licenses, neardups, packing, quality, secrets, spelling, substrings, webp
from shelfmark.llm._text import table


def _docs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _docs(licenses.scan),
        "op2_substring_dedup": _docs(substrings.digests),
        "op3_ngram_jaccard": _docs(neardups.near_duplicates),
        "op4_language_id": _docs(lambda d: language.identify(d)),
        "op5_quality": lambda spark, sf_dir: quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op6_packing": _docs(lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)),
        "op7_lossless_webp": _docs(webp.stored),
        "op8_hamming_top_k": lambda spark, sf_dir: hamming.search(table(spark, sf_dir, "embeddings")),
        "op9_secret_scan": _docs(secrets.scan),
        "op10_bpe": _docs(lambda d: bpe.digests(d, public_tokenizers.path("word_bpe_49k.json"))),
        "op11_kneser_ney": _docs(kneser_ney.scored),
        "op12_spelling_variants": _docs(spelling.variants),
        "op13_token_alignment": _docs(lambda d: alignment.aligned_documents(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))),
        "pipeline": _pipeline,
    }


SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
each AS (SELECT doc_id, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM g GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM sets),
r AS (SELECT g.* FROM g JOIN classes c ON g.doc_id = c.doc_id AND c.doc_id = c.class_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 75 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, other) AS (SELECT x, x FROM both_ways UNION SELECT reach.id, b.y FROM reach JOIN both_ways b ON reach.other = b.x),
low AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.component, c.class_id, w.doc_id) AS component_id, coalesce(c.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN classes c USING (doc_id) LEFT JOIN low ON low.id = c.class_id
"""


#: crc32 of `b`, a list of bytes, with the table `crc` of 256 remainders.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS rest)"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {b}), lambda c, x: xor(c >> 8, rest[xor(c & 255, x) + 1])))"
ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"

KNESER_NEY = rf"""
WITH {CRC_TABLE},
t AS (SELECT doc_id, {CRC.format(b=ID_BYTES)} % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ' end') AS words FROM documents, crc),
each AS (SELECT doc_id, held_out, unnest(list_prepend(' start', words[:-2])) AS a, unnest(words) AS w FROM t),
uni AS (SELECT w, count(*) AS c FROM each WHERE NOT held_out GROUP BY w),
size AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS tokens, count(*) AS v FROM uni),
bi AS (SELECT a, w, count(*) AS c FROM each WHERE NOT held_out GROUP BY a, w),
left_of AS (SELECT w, count(*) AS c FROM bi GROUP BY w),
counts AS (SELECT 2 AS n, count_if(c = 1) AS n1, count_if(c = 2) AS n2, count_if(c = 3) AS n3, count_if(c = 4) AS n4 FROM bi
  UNION ALL SELECT 1, count_if(c = 1), count_if(c = 2), count_if(c = 3), count_if(c = 4) FROM left_of),
d AS (SELECT n, CASE WHEN n1 * n2 * n3 * n4 = 0 THEN 0.5E0 ELSE least(greatest(1 - 2 * (n1 / (n1 + 2 * n2)) * n2 / n1, 0), 1) END AS d1,
  CASE WHEN n1 * n2 * n3 * n4 = 0 THEN 1E0 ELSE least(greatest(2 - 3 * (n1 / (n1 + 2 * n2)) * n3 / n2, 0), 2) END AS d2,
  CASE WHEN n1 * n2 * n3 * n4 = 0 THEN 1.5E0 ELSE least(greatest(3 - 4 * (n1 / (n1 + 2 * n2)) * n4 / n3, 0), 3) END AS d3 FROM counts),
low AS (SELECT w, greatest(c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / sum(c) OVER () AS p FROM left_of, d WHERE n = 1),
low_rest AS (SELECT (any_value(d1) * count_if(c = 1) + any_value(d2) * count_if(c = 2) + any_value(d3) * count_if(c > 2)) / sum(c) AS rest FROM left_of, d WHERE n = 1),
high AS (SELECT a, sum(c) AS total, (any_value(d1) * count_if(c = 1) + any_value(d2) * count_if(c = 2) + any_value(d3) * count_if(c > 2)) / sum(c) AS rest FROM bi, d WHERE n = 2 GROUP BY a),
told AS (SELECT e.doc_id, coalesce(uni.c, 0) AS c, coalesce(low.p, 0) + low_rest.rest / (v + 1) AS p1, high.total, high.rest,
  coalesce(greatest(bi.c - CASE bi.c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0), 0) AS kept, tokens, v
  FROM each e CROSS JOIN size CROSS JOIN low_rest CROSS JOIN (SELECT * FROM d WHERE n = 2) LEFT JOIN uni USING (w) LEFT JOIN low USING (w) LEFT JOIN high USING (a) LEFT JOIN bi ON bi.a = e.a AND bi.w = e.w)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count_if(c > 0) AS n_known, any_value(tokens) AS train_tokens,
  round(sum(log10((c + 1) / (tokens + v + 1))), 6) AS base_score, round(sum(log10(CASE WHEN total IS NULL THEN p1 ELSE kept / total + told.rest * p1 END)), 6) AS score
FROM told JOIN t USING (doc_id) GROUP BY doc_id
"""

RUN_BYTES = f"list_concat({ID_BYTES}, [58], flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)))"

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, c, {CRC.format(b=RUN_BYTES)} AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
near AS (SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS best, max(n) AS best_n FROM pairs JOIN words ON word = y GROUP BY x),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON x = word),
chain(word, last) AS (SELECT word, form FROM told WHERE form IS NOT NULL UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON chain.last = told.word WHERE told.form IS NOT NULL),
ends AS (SELECT chain.word, last FROM chain JOIN told ON chain.last = told.word WHERE told.form IS NULL)
SELECT word, form, coalesce(last, word) AS root, n, n_near, form_n FROM told LEFT JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op2_substring_dedup": SUBSTRINGS, "op3_ngram_jaccard": NEAR_DUPLICATES, "op11_kneser_ney": KNESER_NEY, "op12_spelling_variants": SPELLING}
