"""The queries' SQL for DuckDB: name, views it stands on, body. Written apart from the operators, as a second opinion."""

from __future__ import annotations

from shelfmark.functions.text import (
    ACRONYMS, BOGUS, CORPORATE, EDITION_TAG, EXTENSIONS, FORMATS, JUNK, KEY_ARTICLES, OCR_LANGUAGES, PAIRS, PARTICLES, PERIODICALS, PROMOTION, SMALL, SORT_ARTICLES,
)
from shelfmark.operators.covers import WORDS
from shelfmark.operators.profile import STATES, STEPS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_in = lambda xs: "(" + ", ".join(map(_q, xs)) + ")"


def _digits(x: str, n: int, weights: list[int]) -> str:
    return " + ".join(f"{w} * CAST(substr({x}, {i + 1}, 1) AS INT)" for i, w in zip(range(n), weights))


def ok13(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]{{13}}') THEN ({_digits(x, 13, [1, 3] * 7)}) % 10 = 0 ELSE FALSE END)"


def ok10(x: str) -> str:
    last = f"CASE WHEN substr({x}, 10, 1) = 'X' THEN 10 ELSE CAST(substr({x}, 10, 1) AS INT) END"
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]{{9}}[0-9X]') THEN ({_digits(x, 9, list(range(10, 1, -1)))} + {last}) % 11 = 0 ELSE FALSE END)"


def to13(x: str) -> str:
    body = f"('978' || substr({x}, 1, 9))"
    return f"({body} || CAST((10 - ({_digits(body, 12, [1, 3] * 6)}) % 10) % 10 AS VARCHAR))"


def canonical(x: str) -> str:
    return f"CASE WHEN {ok13(x)} THEN {x} WHEN {ok10(x)} THEN {to13(x)} END"


def key(x: str) -> str:
    plain = f"trim(lower(regexp_replace(coalesce({x}, ''), '[^a-zA-Z0-9\\s+#]', ' ', 'g')))"
    return f"trim(regexp_replace(regexp_replace({plain}, '^((?:{KEY_ARTICLES})\\s+)+', ''), '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    for e in EXTENSIONS:
        t = f"trim(regexp_replace({t}, '\\.{e}$', '', 'i'))"
    for p in JUNK:
        t = f"trim(regexp_replace({t}, {_q(p)}, '', 'gi'))"
    t = f"regexp_replace(regexp_replace({t}, '^[\\s\\-_:.]+|[\\s\\-_:.]+$', '', 'g'), '\\s+', ' ', 'g')"
    return f"regexp_replace(trim(regexp_replace({t}, '\\(\\s*\\)|\\[\\s*\\]', '', 'g')), '\\s+', ' ', 'g')"


def title_sort(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    arms = " ".join(f"WHEN starts_with(lower({t}), {_q(a)}) THEN trim(substr({t}, {len(a) + 1})) || ', ' || regexp_replace(trim(substr({t}, 1, {len(a)})), '''$', '')" for a in SORT_ARTICLES)
    return f"CASE {arms} ELSE {t} END"


def display(x: str) -> str:
    last, first = f"trim(split_part({x}, ',', 1))", f"trim(substr({x}, strpos({x}, ',') + 1))"
    return (
        f"CASE WHEN NOT contains({x}, ',') THEN regexp_replace(trim({x}), '\\s+', ' ', 'g') WHEN lower({first}) IN ('saint', 'st.') THEN 'Saint ' || {last} WHEN lower({first}) IN ('pope', 'papa') THEN 'Pope ' || {last} "
        f"WHEN lower({first}) IN ('the', 'der') THEN upper(substr({first}, 1, 1)) || lower(substr({first}, 2)) || ' ' || {last} ELSE {first} || ' ' || {last} END"
    )


def author_sort(x: str) -> str:
    n = f"trim({x})"
    w = f"string_split({n}, ' ')"
    behind = lambda k: f"array_to_string({w}[-{k}:], ' ') || ', ' || array_to_string({w}[:-{k + 1}], ' ')"
    corporate = " ".join(f"WHEN lower({n}) = {_q(a)} THEN {_q(b)}" for a, b in CORPORATE.items())
    return (
        f"CASE {corporate} WHEN contains({n}, ',') THEN {n} WHEN starts_with({n}, 'Pope ') THEN substr({n}, 6) || ', Pope' WHEN len({w}) = 1 THEN {n} "
        f"WHEN lower({n}) = 'mario vargas llosa' THEN 'Vargas Llosa, Mario' WHEN len({w}) >= 4 AND lower(array_to_string({w}[-3:-2], ' ')) IN {_in(PAIRS)} THEN {behind(3)} "
        f"WHEN len({w}) >= 3 AND lower({w}[-2]) IN {_in(PARTICLES)} THEN {behind(2)} ELSE {behind(1)} END"
    )


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0E0 WHEN least(length({a}), length({b})) = 0 THEN 0.0E0 ELSE 1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


#: x, y and what token sets make of them: i common, one and two with either rest.
def _sets(source: str, a: str, b: str, keep: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    rest = lambda p, q: f"array_to_string(list_sort(list_filter({p}, lambda z: NOT list_contains({q}, z))), ' ')"
    common = f"array_to_string(list_sort(list_intersect({x}, {y})), ' ')"
    return f"(SELECT {keep}, {a} AS x, {b} AS y, {common} AS i, trim({common} || ' ' || {rest(x, y)}) AS one, trim({common} || ' ' || {rest(y, x)}) AS two FROM {source})"


TOKEN_SET = f"greatest({ratio('i', 'one')}, {ratio('i', 'two')}, {ratio('one', 'two')}, {ratio('x', 'y')})"

_ISBN = "(SELECT *, coalesce(isbn, '') AS c, coalesce(substr(isbn, 4, 10), '') AS t FROM books_isbn)"

_OBSERVED = """(SELECT book_id, coalesce(isbn, '') AS di, coalesce(CASE WHEN book_id % 4 = 0 THEN isbn_body || '0' ELSE isbn END, '') AS oi, lower(language) AS dl,
  CASE WHEN book_id % 6 = 0 THEN 'it' ELSE lower(language) END AS ol, lower(series) AS ds, CASE WHEN book_id % 10 = 0 THEN NULL ELSE lower(series) END AS os, book_id % 3 = 0 AS sampled,
  series_index AS dn, floor(series_index) AS on_ FROM books_isbn)"""
_VALID = lambda x: f"({ok10(x)} OR {ok13(x)})"
_VERDICTS = f"""(
SELECT book_id, 'isbn' AS field, unnest(CASE WHEN di = '' AND oi = '' THEN {{'verdict': 'ambiguous', 'confidence': 0, 'flag': '', 'review': FALSE}}
  WHEN di = '' AND {_VALID('oi')} THEN {{'verdict': 'missing', 'confidence': 95, 'flag': '', 'review': FALSE}} WHEN di = '' THEN {{'verdict': 'ambiguous', 'confidence': 40, 'flag': '', 'review': FALSE}}
  WHEN oi = '' THEN {{'verdict': 'ambiguous', 'confidence': 50, 'flag': '', 'review': FALSE}} WHEN NOT {_VALID('di')} AND NOT {_VALID('oi')} THEN {{'verdict': 'ambiguous', 'confidence': 30, 'flag': '', 'review': FALSE}}
  WHEN di = oi THEN {{'verdict': 'confirmed', 'confidence': 99, 'flag': '', 'review': FALSE}} WHEN {_VALID('di')} AND {_VALID('oi')} THEN {{'verdict': 'mismatch', 'confidence': 98, 'flag': 'isbn_conflict', 'review': TRUE}}
  WHEN {_VALID('oi')} THEN {{'verdict': 'mismatch', 'confidence': 92, 'flag': 'isbn_conflict', 'review': TRUE}} ELSE {{'verdict': 'mismatch', 'confidence': 88, 'flag': 'isbn_conflict', 'review': TRUE}} END) FROM {_OBSERVED}
UNION ALL SELECT book_id, 'language', unnest(CASE WHEN dl IS NULL AND ol IS NULL THEN {{'verdict': 'ambiguous', 'confidence': 0, 'flag': '', 'review': FALSE}} WHEN dl IS NULL THEN {{'verdict': 'missing', 'confidence': 90, 'flag': '', 'review': FALSE}}
  WHEN ol IS NULL THEN {{'verdict': 'ambiguous', 'confidence': 50, 'flag': '', 'review': FALSE}} WHEN dl = ol THEN {{'verdict': 'confirmed', 'confidence': 99, 'flag': '', 'review': FALSE}} ELSE {{'verdict': 'mismatch', 'confidence': 90, 'flag': '', 'review': FALSE}} END) FROM {_OBSERVED}
UNION ALL SELECT book_id, 'series', unnest(CASE WHEN os IS NULL AND NOT sampled THEN {{'verdict': 'ambiguous', 'confidence': 50, 'flag': '', 'review': FALSE}} WHEN os IS NULL THEN {{'verdict': 'mismatch', 'confidence': 80, 'flag': 'series_mismatch', 'review': TRUE}}
  ELSE {{'verdict': 'confirmed', 'confidence': 95, 'flag': '', 'review': FALSE}} END) FROM {_OBSERVED}
UNION ALL SELECT book_id, 'series_index', unnest(CASE WHEN abs(dn - on_) < 0.01 THEN {{'verdict': 'confirmed', 'confidence': 95, 'flag': '', 'review': FALSE}} ELSE {{'verdict': 'mismatch', 'confidence': 90, 'flag': '', 'review': FALSE}} END) FROM {_OBSERVED})"""

_CLUSTERS = """SELECT {keys}, count(DISTINCT k.book_id) AS n_books, array_to_string(list_sort(list(DISTINCT k.book_id)), ',') AS book_ids,
  CASE WHEN count(format) = count(DISTINCT format) AND count(format) > 0 THEN 'MERGE_FORMATS' ELSE 'INSPECT' END AS action, CASE WHEN count(format) = count(DISTINCT format) AND count(format) > 0 THEN {yes} ELSE {no} END AS confidence
FROM {source} k LEFT JOIN (SELECT DISTINCT book_id, format FROM formats) f ON f.book_id = k.book_id GROUP BY {keys} HAVING count(DISTINCT k.book_id) > 1"""
_TITLES = f"(SELECT book_id, {key('title')} AS title_key, {key('author')} AS author_key FROM books WHERE {key('title')} <> '')"
_D2 = _CLUSTERS.format(keys="title_key, author_key", source=_TITLES, yes="0.98E0", no="0.85E0")
_D3 = _CLUSTERS.format(keys="isbn", source=f"(SELECT book_id, isbn FROM books_isbn WHERE regexp_full_match(isbn, '[0-9]{{13}}') AND isbn NOT IN ('1234567890123', '9781234567890', '9780000000000'))", yes="0.99E0", no="0.88E0")

_FULL = """(SELECT series, authors, total_owned, owned, list_filter(range(1, list_max(whole) + 1), lambda v: NOT list_contains(whole, v)) AS missing FROM (
  SELECT series, count(*) AS total_owned, list_sort(list(DISTINCT i)) AS owned, list(DISTINCT CAST(i AS INT)) FILTER (i = floor(i) AND i >= 1) AS whole FROM (SELECT series, CAST(CASE WHEN coalesce(series_index, 0) = 0 THEN 1 ELSE series_index END AS DOUBLE) AS i FROM books WHERE series IS NOT NULL) GROUP BY series)
JOIN (SELECT series, coalesce(string_agg(DISTINCT trim(a), ' & ' ORDER BY trim(a)) FILTER (trim(a) <> ''), 'Unknown') AS authors FROM (SELECT series, unnest(string_split(author, ' & ')) AS a FROM books WHERE series IS NOT NULL) GROUP BY series) USING (series)
WHERE len(whole) > 0 AND list_max(whole) > 1 AND list_max(whole) - list_min(whole) <= 200)"""

_CANDIDATES = _sets("(SELECT c.*, lower(coalesce(b.title, '')) AS bt, lower(b.author) AS ba, b.isbn AS bi, lower(c.title) AS ct, lower(c.author) AS ca FROM candidates c JOIN books_isbn b USING (book_id))", "bt", "ct", "book_id, pos, provider, isbn13, is_hd_cover, ba, ca, bi")
_BY_TITLE = f"(SELECT *, greatest({ratio('x', 'y')}, {TOKEN_SET}) AS title_sim FROM {_CANDIDATES})"
_BY_AUTHOR = _sets(f"(SELECT book_id AS b, pos AS p, provider, isbn13, is_hd_cover, ba, ca, bi, title_sim FROM {_BY_TITLE})", "ba", "ca", "b AS book_id, p AS pos, provider, isbn13, is_hd_cover, bi, title_sim")
_SCORED = f"""(SELECT book_id, pos, provider, title_sim < 0.4 AND a < 0.35 AS tripped, own IS NOT NULL AND c13 IS NOT NULL AND own <> c13 AS conflict,
  greatest(0.0E0, least(1.0E0, CASE WHEN bi IS NOT NULL THEN 0.35E0 * title_sim + 0.25E0 * a + 0.25E0 * same + 0.15E0 * cover ELSE 0.5E0 * title_sim + 0.35E0 * a + 0.15E0 * cover END - CASE WHEN a < 0.25 AND NOT unknown THEN 0.35E0 ELSE 0.0E0 END)) AS score
FROM (SELECT *, CASE WHEN own = c13 THEN 1.0E0 ELSE 0.0E0 END AS same, CASE WHEN is_hd_cover THEN 1.0E0 ELSE 0.0E0 END AS cover FROM (
  SELECT *, x = 'unknown' AS unknown, CASE WHEN x = 'unknown' THEN 0.5E0 ELSE greatest({ratio('x', 'y')}, {TOKEN_SET}) END AS a, {canonical("coalesce(bi, '')")} AS own, {canonical("coalesce(isbn13, '')")} AS c13 FROM {_BY_AUTHOR})))"""

_CQS = f"""(SELECT cover_id, micro, CAST(CASE WHEN micro THEN least(t, 35) ELSE t END AS INT) AS cqs FROM (SELECT cover_id, micro, greatest(0, least(100, floor(
  CASE WHEN micro THEN 2.0E0 ELSE least(25.0E0, CASE WHEN r < 1.1 THEN greatest(5.0E0, p - 8) WHEN r > 2.0 THEN greatest(5.0E0, p - 5) ELSE p END) END
  + CASE WHEN avg_grad < 4 THEN 5.0E0 WHEN avg_grad < 8 THEN 14.0E0 ELSE least(25.0E0, 15.0E0 + avg_grad - 8) END + CASE WHEN std_dev < 20 THEN 6.0E0 ELSE least(25.0E0, std_dev / 75 * 25) END + greatest(0.0E0, 25.0E0 - 8.0E0 * bad)
  - 5.0E0 * (CAST(NOT micro AND low AS INT) + CAST(NOT micro AND (r < 1.1 OR r > 2.0) AS INT) + CAST(avg_grad < 8 AS INT) + CAST(std_dev < 20 AS INT) + CAST(entropy < 1.5 AS INT) + bad)))) AS t
FROM (SELECT *, CAST(width AS BIGINT) * height > 25000000 OR size_bytes > 25000000 AS bomb, width < 100 OR height < 150 AS micro, width < 400 OR height < 600 AS low, CAST(height AS DOUBLE) / width AS r,
  CASE WHEN width < 400 OR height < 600 THEN 10.0E0 * least(width / 400.0E0, height / 600.0E0) ELSE 15.0E0 + 10.0E0 * least(1.0E0, width * height / 2160000.0E0) END AS p,
  {' + '.join(f"CAST(contains(lower(ocr_text), {_q(w)}) AS INT)" for w in WORDS)} AS bad FROM cover_stats)))"""

_INTERNAL, _EXTERNAL = "('content_native', 'ocr_consensus')", "('provider_structured', 'official', 'national_library')"
_CONFIRMED = f"""(SELECT book_id, bool_or(authoritative AND source_kind IN {_INTERNAL} AND value = manifestation_isbn) AS internal, bool_or(authoritative AND source_kind IN {_EXTERNAL} AND value = manifestation_isbn) AS "external" FROM evidence WHERE field = 'identifiers' GROUP BY book_id)"""
_ROOTS = f"""(SELECT o.book_id, o.independence_root FROM evidence o JOIN evidence i ON i.book_id = o.book_id AND i.field = o.field AND i.source_kind IN {_INTERNAL}
WHERE o.source_kind IN {_EXTERNAL} AND o.field IN ('title', 'authors', 'languages') GROUP BY ALL HAVING count(*) FILTER (lower(trim(o.value)) = lower(trim(i.value))) = 3)"""
_REPORT = """(SELECT count(*) AS sample_size, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'A' AND NOT identity_correct) AS false_positives,
  count(*) FILTER (would_auto_apply AND (NOT identity_correct OR NOT patch_correct)) AS false_auto_applies, count(review_seconds) AS timed, round(sum(review_seconds), 3) AS review_seconds, CAST(sum(egress_bytes) AS BIGINT) AS egress_bytes FROM calibration)"""
_LEGAL = " OR ".join(f"(before = '{a}' AND state IN {_in(b)})" for a, b in STEPS.items())

_fold = lambda x: f"strip_accents({x})"
_words = lambda x: f"trim(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')))"


def verify_key(x: str) -> str:
    return _words(f"regexp_replace({_fold(f'coalesce({x}, chr(32))')}, {_q(EDITION_TAG)}, '', 'gi')")


def plain_key(x: str) -> str:
    return _words(_fold(f"coalesce({x}, '')"))


def value_key(field: str, x: str) -> str:
    return (
        f"CASE WHEN {field} IN ('title', 'publisher', 'series') THEN {_words(x)} WHEN {field} = 'authors' THEN array_to_string(list_sort(list_filter(list_transform(string_split({x}, '&'), lambda z: {_words('z')}), lambda z: z <> '')), chr(10)) "
        f"WHEN {field} = 'languages' THEN array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({x}, '[;,]'), lambda z: lower(trim(z))), lambda z: z <> '')), chr(10)) ELSE {x} END"
    )


def clean_author(x: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '^[ \t\n\r;/,\\''\"]+|[ \t\n\r;/,\\''\"]+$', '', 'g'), '\\s+', ' ', 'g'), '[;/]+$', ''))"
    return f"CASE WHEN {t} <> '' AND NOT regexp_full_match({t}, {_q('(?i)(?:' + BOGUS + ')')}) THEN {t} END"


def like(a: str, b: str) -> str:
    """The larger of plain and token-set ratio, as one scalar subquery-free expression over two normals."""
    x, y = f"list_distinct(list_filter(string_split({a}, ' '), lambda z: z <> ''))", f"list_distinct(list_filter(string_split({b}, ' '), lambda z: z <> ''))"
    rest = lambda p, q: f"array_to_string(list_sort(list_filter({p}, lambda z: NOT list_contains({q}, z))), ' ')"
    return f"{{'i': array_to_string(list_sort(list_intersect({x}, {y})), ' '), 'p': {rest(x, y)}, 'q': {rest(y, x)}}}"


def _verdict(*steps: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in steps) + " END"


_none = lambda c: f"coalesce(trim(CAST({c} AS VARCHAR)), '') = ''"
_SETTLED_BASE = f"""(SELECT *, regexp_replace(coalesce(d_isbn, ''), '[ -]', '', 'g') AS di, regexp_replace(coalesce(o_isbn, ''), '[ -]', '', 'g') AS oi, TRY_CAST(regexp_extract(d_date, '^\\s*(\\d{{4}})', 1) AS INT) AS dy, TRY_CAST(regexp_extract(o_date, '^\\s*(\\d{{4}})', 1) AS INT) AS oy FROM pairs)"""


def _numbers(f: str, same: str) -> str:
    return _verdict((f"d_{f} IS NULL AND o_{f} IS NULL", "confirmed|90||false"), (f"d_{f} IS NULL", "missing|85||false"), (f"o_{f} IS NULL", "ambiguous|50||false"), (same, "confirmed|95||false"), ("TRUE", "mismatch|90||false"))


_near = lambda f: f"abs(d_{f} - o_{f}) < 0.01"
_RULES = {
    "isbn": _verdict(
        ("di = '' AND oi = ''", "ambiguous|0||false"), (f"di = '' AND {_VALID('oi')}", "missing|95||false"), ("di = ''", "ambiguous|40||false"), ("oi = ''", "ambiguous|50||false"), (f"NOT {_VALID('di')} AND NOT {_VALID('oi')}", "ambiguous|30||false"),
        ("di = oi", "confirmed|99||false"), (f"CASE WHEN length(di) = 10 AND {ok13('oi')} THEN {to13('di')} = oi ELSE FALSE END", "confirmed|90||false"), (f"CASE WHEN length(oi) = 10 AND {ok13('di')} THEN {to13('oi')} = di ELSE FALSE END", "confirmed|90||false"),
        (f"{_VALID('di')} AND {_VALID('oi')}", "mismatch|98|isbn_conflict|true"), (_VALID("oi"), "mismatch|92|isbn_conflict|true"), ("TRUE", "mismatch|88|isbn_conflict|true"),
    ),
    "published_date": _verdict((f"{_none('d_date')} AND {_none('o_date')}", "ambiguous|0||false"), (_none("d_date"), "missing|85||false"), (_none("o_date"), "ambiguous|50||false"), ("dy IS NULL OR oy IS NULL", "ambiguous|40||false"), ("dy = oy", "confirmed|90||false"), ("abs(dy - oy) = 1", "confirmed|80||false"), ("TRUE", "mismatch|90||true")),
    "language": _verdict((f"{_none('d_language')} AND {_none('o_language')}", "ambiguous|0||false"), (_none("d_language"), "missing|90||false"), (_none("o_language"), "ambiguous|50||false"), ("lower(trim(d_language)) = lower(trim(o_language))", "confirmed|99||false"), ("TRUE", "mismatch|90||false")),
    "series": _verdict(
        (f"{_none('d_series')} AND {_none('o_series')} AND sampled", "confirmed|95||false"), (f"{_none('d_series')} AND {_none('o_series')}", "confirmed|90||false"), (_none("d_series"), "missing|85||false"), (f"{_none('o_series')} AND NOT sampled", "ambiguous|50||false"),
        (_none("o_series"), "mismatch|80|series_mismatch|true"), (f"{verify_key('d_series')} = {verify_key('o_series')}", "confirmed|95||false"), ("TRUE", "mismatch|85|series_mismatch|true"),
    ),
    "series_index": _numbers("series_index", _near("series_index")), "volume": _numbers("volume", "round_even(d_volume, 0) = round_even(o_volume, 0)"), "chapter": _numbers("chapter", _near("chapter")), "series_position": _numbers("series_position", _near("series_position")),
}
_SETTLED = "(SELECT book_id, field, split_part(v, '|', 1) AS verdict, CAST(split_part(v, '|', 2) AS INT) AS confidence, split_part(v, '|', 3) AS flag, split_part(v, '|', 4) = 'true' AS review FROM (" + " UNION ALL ".join(f"SELECT book_id, '{f}' AS field, {r} AS v FROM {_SETTLED_BASE}" for f, r in _RULES.items()) + "))"

_parts = lambda x, by="'&'": f"list_filter(list_transform(string_split(coalesce({x}, ''), {by}), lambda z: trim(z)), lambda z: z <> '')"
_FACTS = f"""(SELECT book_id, count(*) AS n_formats, count(*) FILTER (readable) AS n_readable, count(DISTINCT id) AS n_ids, min(id) AS id, greatest(count(DISTINCT title), count(DISTINCT authors), count(DISTINCT languages)) AS n_values,
  coalesce(bool_and(title IS NOT NULL AND authors IS NOT NULL AND languages IS NOT NULL) FILTER (readable), FALSE) AS complete, arg_min({{'t': title, 'a': authors, 'l': languages}}, format) FILTER (readable) AS core
FROM (SELECT book_id, format, status = 'readable' AS readable, CASE WHEN status = 'readable' THEN {canonical("coalesce(isbn, '')")} END AS id,
  {', '.join(f"CASE WHEN status = 'readable' AND trim({c}) <> '' THEN {value_key(_q(c), c)} END AS {c}" for c in ('title', 'authors', 'languages'))} FROM format_evidence) GROUP BY book_id)"""
_EXACT = "(SELECT DISTINCT e.book_id, e.independence_root FROM evidence e JOIN facts f ON f.book_id = e.book_id AND f.id = e.manifestation_isbn WHERE e.authoritative AND e.source_kind IN ('provider_structured', 'official_page', 'national_library') AND e.field = 'identifiers')"
_ROOT_TESTS = f"""(SELECT book_id, independence_root, bool_or(NOT same AND source_kind IN ('provider_structured', 'official_page', 'national_library')) AS disagrees, count(DISTINCT field) FILTER (same) = 3 AND bool_and(same) AS agrees
FROM (SELECT e.book_id, e.independence_root, e.source_kind, e.field, coalesce({value_key('e.field', 'e.value')} = CASE e.field WHEN 'title' THEN core.t WHEN 'authors' THEN core.a ELSE core.l END, FALSE) AS same
  FROM evidence e JOIN {_EXACT} x USING (book_id, independence_root) JOIN facts f ON f.book_id = e.book_id WHERE e.authoritative AND e.field IN ('title', 'authors', 'languages')) GROUP BY ALL)"""
_C_REASONS = "('format_manifestation_conflict', 'format_expression_conflict', 'external_expression_conflict')"
_LADDER = f"""(SELECT book_id, id, reason, CASE WHEN reason IN {_C_REASONS} THEN 'C' WHEN reason = 'confirmed' THEN 'A' ELSE 'B' END AS tier FROM (SELECT b.book_id, CASE WHEN n_ids = 1 THEN f.id END AS id, CASE WHEN n_ids > 1 THEN 'format_manifestation_conflict' WHEN n_readable < n_formats THEN 'incomplete_format_evidence'
  WHEN f.id IS NULL THEN 'missing_manifestation_identifier' WHEN NOT EXISTS (SELECT 1 FROM evidence e WHERE e.book_id = b.book_id AND e.field = 'identifiers' AND e.authoritative AND e.source_kind IN {_INTERNAL} AND e.manifestation_isbn = f.id AND e.value = f.id) THEN 'missing_internal_manifestation_confirmation'
  WHEN NOT EXISTS (SELECT 1 FROM exact x WHERE x.book_id = b.book_id) THEN 'missing_external_manifestation_confirmation' WHEN n_values > 1 THEN 'format_expression_conflict' WHEN NOT complete THEN 'incomplete_internal_core_evidence'
  WHEN EXISTS (SELECT 1 FROM root_tests r WHERE r.book_id = b.book_id AND r.disagrees) THEN 'external_expression_conflict' WHEN NOT EXISTS (SELECT 1 FROM root_tests r WHERE r.book_id = b.book_id AND r.agrees) THEN 'missing_external_core_confirmation' ELSE 'confirmed' END AS reason
FROM (SELECT book_id FROM evidence UNION SELECT book_id FROM format_evidence) b LEFT JOIN facts f ON f.book_id = b.book_id))"""
_WITH_ROOTS = f"WITH facts AS {_FACTS}, exact AS {_EXACT}, root_tests AS {_ROOT_TESTS}"
_TIERS = f"{_WITH_ROOTS} SELECT book_id, tier, reason, CASE tier WHEN 'A' THEN 'shadowed' WHEN 'C' THEN 'deferred' ELSE 'review' END AS state FROM {_LADDER}"

_ALIKE = lambda x, y, s: f"greatest({ratio(x, y)}, CASE WHEN {x} = '' OR {y} = '' THEN 0.0E0 ELSE greatest(CASE WHEN {s}.i = '' THEN 0.0E0 ELSE {ratio(s + '.i', s + '.one')} END, CASE WHEN {s}.i = '' THEN 0.0E0 ELSE {ratio(s + '.i', s + '.two')} END, {ratio(s + '.one', s + '.two')}) END)"
_one_two = lambda s: f"{{'i': {s}.i, 'one': trim({s}.i || ' ' || {s}.p), 'two': trim({s}.i || ' ' || {s}.q)}}"
_MATCHED = f"""(SELECT *, own IS NOT NULL AND c13 IS NOT NULL AND own <> c13 AS conflict, title_sim < 0.4 AND CASE WHEN raw IN ('', 'unknown') THEN 0.5E0 WHEN ca <> '' THEN alike ELSE 0.0E0 END < 0.35 AS tripped,
  CASE WHEN raw = '' THEN 0.5E0 WHEN ca <> '' THEN alike ELSE 0.0E0 END AS author_score FROM (SELECT book_id, pos, any_value(provider) AS provider, any_value(is_hd_cover) AS is_hd_cover, any_value(cover_url) AS cover_url, any_value(raw) AS raw, any_value(has_isbn) AS has_isbn, any_value(own) AS own, any_value(c13) AS c13, any_value(title_sim) AS title_sim, max(alike) AS alike, max(ca) AS ca FROM (SELECT *, {_ALIKE('t', 'ct', 'st')} AS title_sim, {_ALIKE('a', 'ca', 'sa')} AS alike FROM (SELECT *, {_one_two('s1')} AS st, {_one_two('s2')} AS sa FROM (SELECT *, {like('t', 'ct')} AS s1, {like('a', 'ca')} AS s2
FROM (SELECT c.book_id, pos, provider, is_hd_cover, cover_url, lower(coalesce(b.author, '')) AS raw, coalesce(b.isbn, '') <> '' AS has_isbn, {plain_key('b.title')} AS t, {plain_key('c.title')} AS ct, {plain_key('b.author')} AS a, {plain_key('one')} AS ca,
  {canonical("coalesce(b.isbn, '')")} AS own, {canonical("coalesce(isbn13, '')")} AS c13 FROM (SELECT *, unnest(string_split(coalesce(author, ''), ' & ')) AS one FROM candidates) c JOIN books_isbn b USING (book_id))))) GROUP BY book_id, pos))"""
_RAW = "CASE WHEN has_isbn THEN 0.35E0 * title_sim + 0.25E0 * author_score + 0.25E0 * CASE WHEN own = c13 THEN 1.0E0 ELSE 0.0E0 END + 0.15E0 * cover ELSE 0.5E0 * title_sim + 0.35E0 * author_score + 0.15E0 * cover END - CASE WHEN author_score < 0.25 AND raw <> '' THEN 0.35E0 ELSE 0.0E0 END"
_CANDIDATE = f"(SELECT book_id, pos, provider, c13, tripped, conflict, CASE WHEN tripped THEN 0.0E0 ELSE greatest(0.0E0, least(1.0E0, round_even(({_RAW}) * 1000, 0) / 1000)) END AS score FROM (SELECT *, CASE WHEN is_hd_cover THEN 1.0E0 WHEN cover_url <> '' THEN 0.5E0 ELSE 0.0E0 END AS cover FROM {_MATCHED}))"

_TITLE = f"(SELECT book_id, author, regexp_replace(trim(regexp_replace(trim(coalesce(upper(title) || ' [retail] (EPUB)', '')), {_q('(?i)(\\s*(?:' + PROMOTION + ')\\s*)+$')}, '')), '\\s+', ' ', 'g') AS p, coalesce(title, 'x') || CASE WHEN book_id % 2 = 0 THEN ': a tale' ELSE ' - second part' END AS s FROM books)"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_CASED = f"""array_to_string(list_transform(string_split(p, ' '), lambda w, i: CASE WHEN list_contains({_list(ACRONYMS)}, upper(w)) THEN upper(w) WHEN i > 1 AND list_contains({_list(SMALL)}, lower(w)) THEN lower(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"""
_cut = lambda by: f"trim(substr(s, 1, strpos(s, '{by}') - 1))", lambda by: f"nullif(trim(substr(s, strpos(s, '{by}') + {len(by)})), '')"
_CYRILLIC = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}


def _latin(x: str) -> str:
    t = f"lower({x})"
    for a, b in _CYRILLIC.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"translate({t}, 'абвгдеёзийклмнопрстуфыэъь', 'abvgdeeziyklmnoprstufye')"


_REJECTS = """SELECT book_id, 'title' AS reason FROM library_books WHERE trim(coalesce(title, '')) = '' UNION SELECT book_id, 'publishers' FROM library_publishers GROUP BY book_id HAVING count(*) > 1 UNION SELECT book_id, 'series' FROM library_series GROUP BY book_id HAVING count(*) > 1
UNION SELECT book_id, 'comments' FROM library_comments GROUP BY book_id HAVING count(*) > 1 UNION SELECT book_id, 'identifier:' || lower(type) FROM identifiers GROUP BY book_id, lower(type) HAVING count(*) > 1
UNION SELECT book_id, 'format:' || upper(format) FROM library_formats GROUP BY book_id, upper(format) HAVING count(*) > 1 UNION SELECT book_id, 'file:' || upper(format) FROM library_formats WHERE contains(name, '/')"""
_display_of = lambda x: display(f"({x})")
_MORE: dict[str, tuple[tuple[str, ...], str]] = {
    "N6_N7_N9_N18_keys": (("books",), f"SELECT book_id, {verify_key('title')} AS verify_key, {plain_key('title')} AS plain_key, {_words('title')} AS identity_key, {value_key(_q('authors'), 'author')} AS authors_key, {value_key(_q('languages'), chr(40) + 'language || ' + _q('; EN') + chr(41))} AS languages_key FROM books"),
    "N11_N13_N16_N22_cleansed": (("books",), f"""SELECT book_id, {clean_author('author')} AS author, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(author || ' and Plato; calibre', '(?i)\\s*(?:;|&|\\band\\b|\\bet\\s+al\\.?)\\s*'), lambda z: {clean_author('z')}), lambda z: z IS NOT NULL), lambda z: {display('z')}), '|') AS authors,
  CASE WHEN contains(s, ':') THEN {_cut[0](':')} ELSE {_cut[0](' - ')} END AS main, CASE WHEN contains(s, ':') THEN {_cut[1](':')} ELSE {_cut[1](' - ')} END AS subtitle, {_latin("'Щука Ёж ' || author")} AS latin,
  CASE WHEN length(regexp_replace(p, '\\P{{L}}', '', 'g')) > 3 THEN {_CASED} ELSE p END AS promoted FROM {_TITLE}"""),
    "I1_N17_library": (("library_books", "library_authors", "library_publishers", "library_series", "library_languages", "library_tags", "library_comments", "identifiers", "library_formats"), f"""WITH bad AS ({_REJECTS}),
names AS (SELECT book_id, coalesce((SELECT string_agg(trim(name), '|' ORDER BY link_id) FILTER (trim(name) <> '') FROM library_authors x WHERE x.book_id = b.book_id), '') AS authors,
  coalesce((SELECT string_agg(lower(trim(name)), '|' ORDER BY item_order, link_id) FROM library_languages x WHERE x.book_id = b.book_id), '') AS languages, coalesce((SELECT string_agg(trim(name), '|' ORDER BY link_id) FROM library_tags x WHERE x.book_id = b.book_id), '') AS tags,
  (SELECT name FROM library_publishers x WHERE x.book_id = b.book_id) AS publisher, (SELECT name FROM library_series x WHERE x.book_id = b.book_id) AS series, (SELECT name FROM library_comments x WHERE x.book_id = b.book_id) AS comments,
  coalesce((SELECT string_agg(lower(type) || '=' || value, '|' ORDER BY lower(type)) FROM identifiers x WHERE x.book_id = b.book_id), '') AS identifiers,
  coalesce((SELECT string_agg(b.path || '/' || name || '.' || lower(format), '|' ORDER BY upper(format)) FROM library_formats x WHERE x.book_id = b.book_id), '') AS files
  FROM library_books b WHERE book_id NOT IN (SELECT book_id FROM bad))
SELECT book_id, title, authors, identifiers, languages, publisher, coalesce(pubdate, published_date) AS pubdate, series, CAST(series_index AS DOUBLE) AS series_index, edition AS edition_statement, CASE WHEN has_cover THEN path || '/cover.jpg' END AS cover, author_sort, tags, comments, files FROM names JOIN library_books USING (book_id)"""),
    "I1_library_rejects": (("library_books", "library_publishers", "library_series", "library_comments", "identifiers", "library_formats"), _REJECTS),
    "N29_periodicals": (("books",), f"""WITH rules(place, pattern, author, sort, rating, tags) AS (VALUES {', '.join(f"({i}, {_q(p)}, {_q(a)}, {_q(t)}, {n}, {_q('|'.join(g))})" for i, (p, a, t, n, g) in enumerate(PERIODICALS))}),
b AS (SELECT book_id, concat_ws(' ', CASE WHEN book_id % 3 = 0 THEN 'On' END, author, CAST(CAST(series_index AS DOUBLE) AS VARCHAR)) AS title, book_id % 2 = 0 OR lower(author) IN ('calibre', 'unknown') AS open FROM books)
SELECT book_id, r.author, sort, rating, tags FROM b JOIN rules r ON regexp_matches(title, pattern, 'i') OR open AND contains(lower(title), lower(r.author)) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY NOT regexp_matches(title, pattern, 'i'), place) = 1"""),
    "R9_identifier_patches": (("books_isbn", "identifiers"), f"""WITH cur AS (SELECT book_id, lower(trim(type)) AS k, trim(value) AS v FROM identifiers WHERE book_id % 25 <> 0), old AS (SELECT book_id, k, CASE WHEN k = 'isbn' THEN {canonical('v')} ELSE v END AS v FROM cur),
new AS (SELECT book_id, 'isbn' AS k, CASE WHEN book_id % 3 = 0 THEN {canonical("coalesce(isbn, '')")} ELSE '9780306406157' END AS v FROM books_isbn WHERE book_id % 4 <> 0),
have AS (SELECT book_id, k, v FROM old WHERE v IS NOT NULL), told AS (SELECT * FROM new WHERE v IS NOT NULL),
both_ AS (SELECT * FROM told UNION ALL SELECT h.* FROM have h JOIN new n ON n.book_id = h.book_id WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.book_id = h.book_id AND t.k = h.k)),
line AS (SELECT book_id, string_agg(k || '=' || v, '|' ORDER BY k) AS target FROM both_ GROUP BY book_id), before AS (SELECT book_id, string_agg(k || '=' || v, '|' ORDER BY k) AS target FROM have GROUP BY book_id)
SELECT n.book_id, coalesce(line.target, '') AS target, coalesce(line.target, '') <> coalesce(before.target, '') AS changed FROM new n LEFT JOIN line ON line.book_id = n.book_id LEFT JOIN before ON before.book_id = n.book_id"""),
    "N15_N21_sql_text": (("books",), f"SELECT {title_sort('title')} AS sort, {author_sort('author')} AS author, count(*) AS n FROM (SELECT title, unnest(string_split(author, ' & ')) AS author FROM books) GROUP BY ALL"),
    "N27_N31_X2_tokens": (("tokens",), f"""SELECT book_id, format, token, CASE WHEN token IN {_in(FORMATS)} THEN token ELSE 'OTHER' END AS bucket, CASE WHEN regexp_matches(lower(path), 'copyright|colophon') THEN 'copyright_page' WHEN contains(lower(path), 'title') OR place = 0 THEN 'title_page' ELSE 'body' END AS source,
  list_filter(list_transform(regexp_extract_all(says, '(?:97[89][-\\s]?)?(?:\\d[-\\s]?){{9}}[\\dXx]'), lambda z: upper(regexp_replace(z, '[^0-9Xx]', '', 'g'))), lambda z: length(z) IN (10, 13))[1] AS shaped
FROM (SELECT *, CASE WHEN regexp_full_match(up, '[A-Z0-9]{{1,16}}') THEN up ELSE 'UNKNOWN' END AS token FROM (SELECT *, upper(regexp_replace(trim(made), '^.*\\.', '')) AS up FROM tokens))"""),
    "V1_V5_V11_settled_verdicts": (("pairs",), f"SELECT * FROM {_SETTLED}"),
    "V14_patch_risks": (("pairs",), f"""SELECT book_id, concat_ws(',', CASE WHEN len({_parts('d_authors')}) > 0 AND len({_parts('o_authors')}) > 0 AND NOT list_has_any({_parts('d_authors')}, {_parts('o_authors')}) THEN 'author_swap' END, CASE WHEN d_isbn <> '' AND o_isbn <> '' AND d_isbn <> o_isbn THEN 'isbn_conflict' END) AS risks FROM pairs"""),
    "V15_V16_adjudicated": (("pairs",), f"""SELECT book_id, field, CASE WHEN told THEN answer ELSE verdict END AS verdict, conf AS confidence, flags, CASE WHEN conf < 70 THEN 'defer' WHEN conf < 90 OR flags <> '' THEN 'needs_review' ELSE 'suggest_fix' END AS action
FROM (SELECT *, CAST(CASE WHEN told AND answer <> 'ambiguous' THEN greatest(0, least(100, book_id % 130 - 10)) ELSE confidence END AS INT) AS conf, CASE WHEN told AND book_id % 5 = 0 THEN array_to_string(list_sort(list_filter(['edition_ambiguous', flag], lambda z: z <> '')), ',') ELSE flag END AS flags
  FROM (SELECT *, verdict = 'ambiguous' AND book_id % 2 = 0 AS told, CASE book_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'mismatch' ELSE 'ambiguous' END AS answer FROM {_SETTLED}))"""),
    "V17_open_requests": (("snippets",), "SELECT sha256(text) AS prompt_hash, count(*) AS n_requests FROM snippets WHERE text NOT IN (SELECT text FROM snippets WHERE book_id % 4 = 0) GROUP BY text"),
    "V18_quoted": (("books", "snippets"), "SELECT o.book_id, o.field, o.quote, arg_min(s.source, s.seq) AS source, min(s.seq) AS seq FROM (SELECT book_id, 'title' AS field, title AS quote FROM books UNION ALL SELECT book_id, 'publisher', publisher FROM books) o JOIN snippets s ON s.book_id = o.book_id AND contains(s.text, o.quote) WHERE o.quote <> '' GROUP BY ALL"),
    "C1_C3_candidate_scores": (("books_isbn", "candidates"), f"SELECT book_id, pos, provider, tripped, conflict, score FROM {_CANDIDATE}"),
    "C4_C5_best_candidate": (("books_isbn", "candidates"), f"""SELECT b.book_id, CASE WHEN NOT coalesce(tripped, TRUE) THEN provider ELSE 'local' END AS provider, coalesce(score, 0.0E0) AS score, CASE WHEN NOT coalesce(tripped, TRUE) THEN 'REVIEW_RECOMMENDED' ELSE 'KEEP_LOCAL' END AS decision, 'C' AS tier,
  CASE WHEN r.n IS NULL THEN 'no_candidates' WHEN tripped IS NULL THEN 'candidate_rejected_valid_isbn_conflict' WHEN tripped THEN 'tripwire' ELSE 'best_candidate' END AS reason, CASE WHEN r.n IS NOT NULL AND tripped IS NULL THEN rejected WHEN tripped THEN coalesce(c13, '') ELSE '' END AS quarantine
FROM books_isbn b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, pos) AS k FROM {_CANDIDATE} WHERE NOT conflict) s ON s.book_id = b.book_id AND k = 1
LEFT JOIN (SELECT book_id, count(*) AS n, string_agg(c13, ',' ORDER BY pos) FILTER (conflict) AS rejected FROM {_CANDIDATE} GROUP BY book_id) r ON r.book_id = b.book_id"""),
    "R1_R2_R5_format_tests": (("format_evidence",), f"SELECT * EXCLUDE (core) FROM {_FACTS}"),
    "R7_root_matches": (("evidence", "format_evidence"), f"{_WITH_ROOTS} SELECT book_id, independence_root FROM root_tests WHERE agrees"),
    "R8_field_consensus": (("evidence",), f"""SELECT book_id, field, nv AS n_values, nr AS n_roots, CASE WHEN nv = 1 THEN v END AS value, CASE WHEN nv = 1 AND nr >= 2 AND sure THEN 'auto' ELSE 'review' END AS status
FROM (SELECT book_id, field, count(DISTINCT k) AS nv, count(DISTINCT independence_root) AS nr, min(k) AS v, bool_or(source_kind = 'content_native') AS sure FROM (SELECT *, {value_key('field', 'value')} AS k FROM evidence WHERE authoritative) GROUP BY book_id, field)"""),
    "R9_R10_decisions": (("evidence", "format_evidence", "current_fields"), f"""{_WITH_ROOTS}, ladder AS {_LADDER}, judged AS (SELECT e.book_id, e.field, l.tier, count(DISTINCT k) FILTER (good) AS nv, count(DISTINCT independence_root) FILTER (good) AS nr, coalesce(bool_or(good AND source_kind = 'content_native'), FALSE) AS sure, min(k) FILTER (good) AS k, min(value) FILTER (good) AS told
  FROM (SELECT e.*, {value_key('e.field', 'e.value')} AS k, e.authoritative AND coalesce(e.manifestation_isbn = l.id, FALSE) AS good FROM evidence e JOIN ladder l ON l.book_id = e.book_id) e JOIN ladder l ON l.book_id = e.book_id GROUP BY ALL)
SELECT book_id, field, tier, status, CASE WHEN tier = 'A' AND nv = 1 THEN k END AS resolved, CASE WHEN status = 'auto' THEN told END AS patch FROM (SELECT j.*, CASE WHEN tier = 'C' THEN 'blocked' WHEN tier = 'B' OR nv <> 1 OR nr < 2 OR NOT sure THEN 'review' WHEN k = {value_key('c.field', 'c.value')} THEN 'unchanged' ELSE 'auto' END AS status
  FROM judged j LEFT JOIN current_fields c ON c.book_id = j.book_id AND c.field = j.field)"""),
    "R6_R10_R11_ladder": (("evidence", "format_evidence"), _TIERS),
    "R12_ocr_consensus": (("format_evidence",), f"""SELECT book_id AS file_id, count(*) AS n_engines, CASE WHEN bool_and(c IS NOT NULL) AND count(DISTINCT c) = 1 THEN min(c) END AS isbn, bool_and(c IS NOT NULL) AND count(DISTINCT c) = 1 AND count(*) >= 2 AS authoritative FROM (SELECT book_id, {canonical("coalesce(isbn, '')")} AS c FROM format_evidence) GROUP BY book_id"""),
    "R13_evidence_ids": (("evidence",), "SELECT substr(sha256(CAST(book_id AS VARCHAR) || '|' || independence_root || '|' || field), 1, 20) AS evidence_id, count(*) AS n_rows, count(DISTINCT value || source_kind || CAST(authoritative AS VARCHAR)) > 1 AS clash FROM evidence GROUP BY book_id, independence_root, field"),
    "R14_broken_seals": (("evidence",), "SELECT book_id, independence_root, field, seal FROM (SELECT *, sha256(concat_ws('|', book_id, field, value)) AS seal, sha256(concat_ws('|', book_id, field, CASE WHEN book_id % 50 = 0 THEN upper(value) ELSE value END)) AS again FROM evidence) WHERE seal <> again"),
    "R15_changed_sources": (("formats",), "SELECT CAST(book_id AS VARCHAR) || '/' || format AS file, CASE WHEN book_id % 17 = 0 THEN 'added' WHEN book_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM formats WHERE (book_id % 17 = 0) <> (book_id % 11 = 0) OR (book_id % 13 = 0 AND book_id % 17 <> 0 AND book_id % 11 <> 0)"),
}

ORACLES: dict[str, tuple[tuple[str, ...], str]] = {
    "N1_N5_isbn": (("books_isbn",), f"SELECT book_id, {ok13('c')} AS valid13, {ok10('t')} AS valid10, {canonical('c')} AS canonical, {canonical('t')} AS from10, regexp_full_match(c, '[0-9]{{13}}') AND c NOT IN ('1234567890123', '9781234567890', '9780000000000') AS plausible, CASE WHEN c = '' THEN 'missing' WHEN {ok13('c')} THEN 'valid' ELSE 'invalid' END AS state FROM {_ISBN}"),
    "N8_N10_N21_titles": (("books",), f"SELECT book_id, {key('title')} AS title_key, {clean('title')} AS clean, {title_sort('title')} AS sort, series_index AS number, CASE language {' '.join(f'WHEN {_q(a)} THEN {_q(b)}' for a, b in OCR_LANGUAGES.items())} ELSE 'eng' END AS ocr_language FROM books"),
    "N14_N16_authors": (("books",), f"SELECT book_id, {display('author')} AS display, {author_sort('author')} AS sort, array_to_string([{author_sort('z')} for z in string_split(author, '&')], ' & ') AS all_sorts FROM books"),
    "N23_N24_ratios": (("books",), f"SELECT book_id, round({ratio('x', 'y')}, 6) AS ratio, round({TOKEN_SET}, 6) AS token_set FROM {_sets('(SELECT book_id, lower(coalesce(title, chr(32))) AS l, lower(observed_title) AS o FROM books)', 'trim(l)', 'o', 'book_id')}"),
    "N28_text_quality": ((), r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR length(regexp_replace(text, '[^\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g')) > 0.1 * length(text) OR len(regexp_extract_all(text, '\S+')) < 5 THEN 'low' ELSE 'high' END AS quality FROM documents"),
    "C1_C3_candidate_scores": (("books_isbn", "candidates"), f"SELECT book_id, pos, provider, tripped, conflict, round(score, 6) AS score FROM {_SCORED}"),
    "C4_C5_best_candidate": (("books_isbn", "candidates"), f"SELECT b.book_id, coalesce(provider, 'local') AS provider, round(coalesce(score, 0.0E0), 6) AS score, CASE WHEN provider IS NULL THEN 'KEEP_LOCAL' ELSE 'REVIEW_RECOMMENDED' END AS decision FROM books_isbn b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY round(score, 9) DESC, pos) AS n FROM {_SCORED} WHERE NOT tripped AND NOT conflict) s ON s.book_id = b.book_id AND n = 1"),
    "D5_all_pair_duplicates": (("books_isbn",), """SELECT * FROM (SELECT type, min(book_id) OVER (PARTITION BY type, value) AS first_id, book_id, value FROM (SELECT 'isbn_match' AS type, book_id, isbn AS value FROM books_isbn WHERE isbn <> ''
UNION ALL SELECT 'title_author_match', book_id, trim(lower(coalesce(title, ''))) || '|' || trim(lower(coalesce(author, ''))) FROM books_isbn)) WHERE book_id <> first_id"""),
    "D8_near_hashes": (("cover_stats",), "SELECT a.phash AS left_hash, b.phash AS right_hash, a.n AS left_covers, b.n AS right_covers, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM (SELECT phash, count(*) AS n FROM cover_stats GROUP BY phash) a JOIN (SELECT phash, count(*) AS n FROM cover_stats GROUP BY phash) b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 4"),
    "Q1_inventory": (("books_isbn", "formats"), f"""SELECT count(*) AS books, CAST(sum(coalesce(n, 0)) AS BIGINT) AS formats, count(*) FILTER (n > 1) AS multi_format, count(*) FILTER (n IS NULL) AS no_format, count(*) FILTER (c = '') AS isbn_missing, count(*) FILTER ({ok13('c')}) AS isbn_valid,
  count(*) FILTER (c <> '' AND NOT {ok13('c')}) AS isbn_invalid, count(*) FILTER (coalesce(trim(title), '') = '') AS blank_title, count(*) FILTER (coalesce(trim(author), '') = '') AS blank_author, count(*) FILTER (coalesce(trim(language), '') = '') AS blank_language
FROM {_ISBN} b LEFT JOIN (SELECT book_id, count(*) AS n FROM formats GROUP BY book_id) f ON f.book_id = b.book_id"""),
    "Q1_languages": (("books",), "SELECT coalesce(language, 'unknown') AS value, count(*) AS n FROM books GROUP BY 1"),
    "Q6_without_formats": (("books", "formats"), "SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM formats)"),
    "Q8_cover_classes": (("cover_stats",), "SELECT cover_id, CASE WHEN size_bytes < 4000 THEN 'tiny' WHEN width * height > 30000000 OR size_bytes > 15000000 THEN 'huge' WHEN width < 200 OR height < 250 THEN 'tiny' ELSE 'fine' END AS size_class FROM cover_stats"),
    "Q17_requests": (("requests",), "SELECT route, status, count(*) AS n, round(avg(duration_s), 6) AS mean_s FROM requests GROUP BY route, status"),
    "K1_calibration": (("calibration",), f"SELECT * FROM {_REPORT}"),
    "K2_repeated_ids": (("calibration",), "SELECT evidence_id, count(*) AS n FROM calibration GROUP BY evidence_id HAVING count(*) > 1"),
    "L1_progress": (("runs",), "SELECT count(*) AS total, count(*) FILTER (status IN ('completed', 'failed', 'skipped')) AS done, CASE WHEN count(*) = 0 THEN 100.0E0 ELSE round(100.0E0 * count(*) FILTER (status IN ('completed', 'failed', 'skipped')) / count(*), 6) END AS percent FROM runs"),
    "L4_claimable": (("runs",), "SELECT run_id, status FROM runs WHERE finished_at IS NULL AND (lease_owner IS NULL OR lease_expires_at < TIMESTAMP '1996-01-01 00:00:00')"),
    "L9_illegal_steps": (("operations",), f"SELECT operation_id, before, state FROM (SELECT operation_id, state, lag(state) OVER (PARTITION BY book_key ORDER BY created_at, operation_id) AS before FROM operations) WHERE before IS NOT NULL AND NOT ({_LEGAL})"),
    "L10_first_requests": (("operations",), "SELECT idempotency_key, operation_id, state FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, operation_id) AS n FROM operations) WHERE n = 1"),
    "P3_P6_cover_quality": (("cover_stats",), f"SELECT cover_id, cqs, CASE WHEN cqs >= 80 THEN 'A' WHEN cqs >= 65 THEN 'B' WHEN cqs >= 45 THEN 'C' ELSE 'D' END AS tier, cqs < 60 OR micro AS actionable FROM {_CQS}"),
    "P10_oversize": (("cover_stats",), "SELECT cover_id FROM cover_stats WHERE width * height > 30000000 OR size_bytes > 10000000"),
    "R3_R4_confirmations": (("evidence",), f"SELECT * FROM {_CONFIRMED}"),
    "R7_root_matches": (("evidence",), f"SELECT * FROM {_ROOTS}"),
    "R8_field_consensus": (("evidence",), f"""SELECT book_id, field, nv AS n_values, nr AS n_roots, CASE WHEN nv = 1 THEN v END AS value, CASE WHEN nv = 1 AND nr >= 2 AND sure THEN 'auto' ELSE 'review' END AS status
FROM (SELECT book_id, field, count(DISTINCT lower(trim(value))) AS nv, count(DISTINCT independence_root) AS nr, min(lower(trim(value))) AS v, bool_or(source_kind IN ('content_native', 'ocr_consensus', 'official')) AS sure FROM evidence WHERE authoritative GROUP BY book_id, field)"""),
    "R6_R10_R11_ladder": (("evidence",), f"""SELECT book_id, CASE reason WHEN 'confirmed' THEN 'A' WHEN 'external_expression_conflict' THEN 'C' ELSE 'B' END AS tier, reason, CASE reason WHEN 'confirmed' THEN 'shadowed' WHEN 'external_expression_conflict' THEN 'deferred' ELSE 'review' END AS state
FROM (SELECT b.book_id, CASE WHEN isbn IS NULL THEN 'missing_manifestation_identifier' WHEN NOT coalesce(internal, FALSE) THEN 'missing_internal_manifestation_confirmation' WHEN NOT coalesce("external", FALSE) THEN 'missing_external_manifestation_confirmation'
  WHEN (SELECT count(DISTINCT i.field) FROM evidence i WHERE i.book_id = b.book_id AND i.authoritative AND i.source_kind IN {_INTERNAL} AND i.field IN ('title', 'authors', 'languages')) < 3 THEN 'incomplete_internal_core_evidence'
  WHEN EXISTS (SELECT 1 FROM evidence x JOIN evidence o ON o.book_id = x.book_id AND o.independence_root = x.independence_root JOIN evidence i ON i.book_id = o.book_id AND i.field = o.field WHERE x.book_id = b.book_id
    AND x.authoritative AND x.source_kind IN {_EXTERNAL} AND x.field = 'identifiers' AND x.value = x.manifestation_isbn AND o.authoritative AND o.source_kind IN {_EXTERNAL} AND o.field IN ('title', 'authors', 'languages')
    AND i.authoritative AND i.source_kind IN {_INTERNAL} AND lower(trim(o.value)) <> lower(trim(i.value))) THEN 'external_expression_conflict'
  WHEN r.book_id IS NULL THEN 'missing_external_core_confirmation' ELSE 'confirmed' END AS reason
FROM (SELECT book_id, max(manifestation_isbn) AS isbn FROM evidence GROUP BY book_id) b LEFT JOIN {_CONFIRMED} c ON c.book_id = b.book_id LEFT JOIN (SELECT DISTINCT book_id FROM {_ROOTS}) r ON r.book_id = b.book_id)"""),
    "E1_snippet_text": (("books", "snippets"), """SELECT book_id, t AS embedding_text, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT b.book_id, md5(CAST(b.book_id AS VARCHAR)) AS h, coalesce(title, '') || CASE WHEN author <> '' THEN ' by ' || author ELSE '' END || CASE WHEN s.book_id IS NULL THEN '' ELSE chr(10) || chr(10) || 'Snippet: ' || substr(coalesce(s.text, ''), 1, 500) END AS t
  FROM books b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS n FROM snippets) WHERE n = 1) s ON s.book_id = b.book_id) WHERE trim(t) <> ''"""),
    "E2_nearest": ((), """SELECT query_id, neighbour_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS INT) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5"""),
    "T2_error_windows": (("requests",), """SELECT start_s, count(*) AS n, count(*) FILTER (status >= 500) AS errors FROM (SELECT status, unnest(range(CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 - 240, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 + 1, 60)) AS start_s FROM requests) GROUP BY start_s HAVING count(*) FILTER (status >= 500) / count(*) > 0.05"""),
}
ORACLES |= _MORE

_ROLLED = f"""SELECT book_id, confidence, flags, patch, action, action = 'suggest_fix' AND patched >= 80 AND sound AS eligible FROM (SELECT *, CASE WHEN flags <> '' OR unsure THEN 'needs_review' WHEN n = 0 OR patch = '' THEN 'no_change' WHEN confidence >= 85 THEN 'suggest_fix' WHEN confidence >= 70 THEN 'needs_review' ELSE 'defer' END AS action
FROM (SELECT book_id, CAST(coalesce(floor(avg(confidence) FILTER (verdict <> 'ambiguous')), 0) AS INT) AS confidence, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag) FILTER (flag <> ''), '') AS flags,
  array_to_string(list_filter(['isbn', 'language', 'series', 'series_index'], lambda f: list_contains(coalesce(list(field) FILTER (verdict IN ('mismatch', 'missing')), []), f)), ',') AS patch,
  bool_or(verdict = 'ambiguous' AND confidence > 0) AS unsure, count(*) FILTER (verdict <> 'ambiguous') AS n, coalesce(floor(avg(confidence) FILTER (verdict IN ('mismatch', 'missing'))), 0) AS patched,
  bool_and(verdict NOT IN ('mismatch', 'missing') OR (confidence >= 75 AND NOT review)) AS sound FROM {_VERDICTS} GROUP BY book_id))"""
_GATE = "(SELECT count(*) AS sample_size, count(*) FILTER (tier = 'A') AS tier_a, count(*) FILTER (tier = 'A' AND NOT identity_correct) AS false_positives, count(*) FILTER (would_auto_apply AND (NOT identity_correct OR NOT patch_correct)) AS false_auto_applies, count(review_seconds) AS timed, CAST(sum(egress_bytes) AS BIGINT) AS egress_bytes FROM calibration)"
_SEAL = "sha256(concat_ws('|', sample_size, tier_a, false_positives, false_auto_applies, timed, coalesce(CAST(egress_bytes AS VARCHAR), '~')))"
_FAILS = "concat_ws(',', CASE WHEN sample_size < 100 THEN 'sample_too_small' END, CASE WHEN tier_a < 50 THEN 'tier_a_too_small' END, CASE WHEN false_auto_applies <> 0 THEN 'false_auto_applies' END, CASE WHEN false_positives > 0 THEN 'false_positive_rate' END{})"
_case = lambda n, reasons: f"SELECT {n} AS case_no, {reasons} AS reasons, {reasons} = '' AS open FROM {_GATE}"
_LEVEL = lambda source: f"(SELECT CAST(floor(k / 4096.0) AS BIGINT) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM {source} GROUP BY 1)"
_MANIFEST = "(SELECT b.book_id AS k, sha256(CAST(b.book_id AS VARCHAR) || '|' || coalesce(f.formats, '') || '|' || coalesce(b.last_modified, '')) AS h FROM books b LEFT JOIN (SELECT book_id, string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM formats GROUP BY book_id) f ON f.book_id = b.book_id)"
_BAD = r"CASE WHEN title ILIKE '%[welib.org]%' THEN '\[welib\.org\]' WHEN title ILIKE '%(z-library)%' THEN '\(z-library\)' WHEN contains(lower(title), '_print') THEN '_print' WHEN contains(lower(title), 'untitled') THEN 'untitled' WHEN contains(lower(title), 'microsoft word') THEN 'microsoft word' WHEN regexp_matches(lower(title), 'v[0-9]+\.[0-9]+') THEN 'v\d+\.\d+' WHEN regexp_matches(lower(title), '\.(pdf|epub|mobi|azw3)$') THEN 'ends_with_extension' END"
_OPEN = """(SELECT state, count(*) AS n FROM ledger_operations o WHERE policy_version = 'manifestation-v2' AND (state <> 'failed' OR NOT EXISTS (SELECT 1 FROM acknowledgements a JOIN pilots p ON p.pilot_id = o.pilot_id JOIN outbox x ON x.aggregate_id = o.operation_id AND x.status = 'failed'
  LEFT JOIN write_locks l ON l.book_key = o.book_key WHERE a.operation_id = o.operation_id AND o.completed_at IS NOT NULL AND p.state = 'stopped' AND o.pilot_id <> 'pilot-3' AND l.book_key IS NULL)) GROUP BY state)"""
_first = lambda name, source: f"SELECT '{name}' AS finding, (SELECT count(*) FROM {source}) AS n, coalesce((SELECT string_agg(CAST(book_id AS VARCHAR), ',' ORDER BY book_id) FROM (SELECT book_id FROM {source} ORDER BY book_id LIMIT 10)), '') AS first_ids"
_HASH_CACHE = "(SELECT md5(CAST(size_bytes AS VARCHAR)) AS digest, phash, 'a' || CAST(cover_id AS VARCHAR) AS answer, cover_id AS seq FROM cover_stats WHERE cover_id % 9 = 0)"
_D4 = f"""WITH RECURSIVE keyed AS (SELECT book_id, {canonical("coalesce(isbn, '')")} AS i, lower(coalesce({clean_author('author')}, '')) AS a, lower(trim(title)) AS t FROM books_isbn),
blocks AS (SELECT book_id, 'i:' || i AS block FROM keyed WHERE i IS NOT NULL UNION ALL SELECT book_id, 't:' || a || chr(10) || t FROM keyed WHERE t <> ''),
stars AS (SELECT book_id AS x, min(book_id) OVER (PARTITION BY block) AS y FROM blocks), edges AS (SELECT x, y FROM stars WHERE x <> y UNION SELECT y, x FROM stars WHERE x <> y),
reach(id, other) AS (SELECT x, x FROM edges UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.other = e.x), member AS (SELECT id AS book_id, min(other) AS cluster_id FROM reach GROUP BY id),
maps AS (SELECT book_id, string_agg(DISTINCT upper(format) || '=' || digest, ';' ORDER BY upper(format) || '=' || digest) AS m, count(*) = count(DISTINCT format) AS whole, bool_or(format = 'EPUB') AS epub, bool_or(format = 'PDF') AS pdf FROM formats GROUP BY book_id),
told AS (SELECT m.cluster_id, count(*) AS n_books, bool_and(coalesce(whole, FALSE)) AS whole, count(DISTINCT maps.m) AS n_maps, coalesce(bool_or(epub), FALSE) AS epub, coalesce(bool_or(pdf), FALSE) AS pdf, min(m.book_id) AS least, min(m.book_id) FILTER (epub) AS first_epub FROM member m LEFT JOIN maps ON maps.book_id = m.book_id GROUP BY m.cluster_id),
held AS (SELECT m.cluster_id, count(*) AS n, count(DISTINCT f.format) AS d FROM member m JOIN formats f ON f.book_id = m.book_id GROUP BY m.cluster_id)
SELECT told.cluster_id, n_books, kind, CASE kind WHEN 'CLONE' THEN 1.0E0 ELSE 0.75E0 END AS confidence, coalesce(first_epub, least) AS canonical_id FROM (SELECT told.*, CASE WHEN whole AND n_maps = 1 THEN 'CLONE' WHEN coalesce(n, 0) = coalesce(d, 0) AND n_books = 2 AND epub AND pdf THEN 'MULTIFORMAT' ELSE 'EDITION' END AS kind FROM told LEFT JOIN held ON held.cluster_id = told.cluster_id) told"""
_SPURIOUS = "(SELECT *, lower(ocr_text) AS o, white_ratio > 0.8 AND dark_ratio > 0.015 AND dark_ratio < 0.22 AS inside FROM cover_stats)"
_P8 = "CASE WHEN her >= 6.5 AND acf >= 0.28 THEN {0} WHEN her >= 6.5 AND folio THEN {1} WHEN acf >= 0.28 * 1.3 AND her >= 3.0 AND entropy < 4.0 THEN {2} WHEN mono THEN {3} WHEN CAST(height AS DOUBLE) / width < 1.0 OR CAST(height AS DOUBLE) / width > 2.2 THEN {4} WHEN width < 300 OR height < 400 THEN {5} END"
ORACLES |= {
    "D1_file_hashes": ((), "SELECT doc_id AS file_id, sha256(text) AS full FROM (SELECT *, count(*) OVER (PARTITION BY strlen(text), CASE WHEN strlen(text) <= 65536 THEN text ELSE md5(left(text, 20000)) END) AS n FROM documents) WHERE n > 1"),
    "D4_work_clusters": (("books_isbn", "formats"), _D4),
    "D6_semantic_pairs": ((), f"SELECT least(query_id, neighbour_id) AS left_id, greatest(query_id, neighbour_id) AS right_id, max(score) AS score FROM ({ORACLES['E2_nearest'][1].replace('q.vec_id % 50 = 0 AND ', '')}) WHERE score > 0.3 GROUP BY 1, 2"),
    "E2_all_nearest": ((), ORACLES['E2_nearest'][1].replace('q.vec_id % 50 = 0 AND ', '')),
    "D9_reused_answers": (("cover_stats",), f"""SELECT cover_id, CASE WHEN d IS NOT NULL THEN 'digest' WHEN h IS NOT NULL THEN 'hash' ELSE 'near' END AS how, coalesce(d, h, n) AS answer FROM (SELECT c.cover_id, (SELECT arg_max(answer, seq) FROM {_HASH_CACHE} x WHERE x.digest = md5(CAST(c.size_bytes AS VARCHAR))) AS d,
  (SELECT arg_max(answer, seq) FROM {_HASH_CACHE} x WHERE x.phash = c.phash) AS h, (SELECT arg_min(answer, CAST(bit_count(xor(x.phash, c.phash)) AS BIGINT) * 1000000000 - seq) FROM (SELECT * FROM {_HASH_CACHE} ORDER BY seq DESC LIMIT 150) x WHERE bit_count(xor(x.phash, c.phash)) <= 4) AS n FROM cover_stats c) WHERE coalesce(d, h, n) IS NOT NULL"""),
    "D2_title_author_clusters": (("books", "formats"), f"SELECT title_key, author_key, min(book_id) OVER (PARTITION BY title_key, author_key) AS cluster_id, book_id, n_books, action, confidence FROM (SELECT *, unnest(CAST(string_split(book_ids, ',') AS BIGINT[])) AS book_id FROM ({_D2}))"),
    "D3_isbn_clusters": (("books_isbn", "formats"), f"SELECT isbn, min(book_id) OVER (PARTITION BY isbn) AS cluster_id, book_id, n_books, action, confidence FROM (SELECT *, unnest(CAST(string_split(book_ids, ',') AS BIGINT[])) AS book_id FROM ({_D3}) WHERE book_ids NOT IN (SELECT book_ids FROM ({_D2})))"),
    "D7_duplicate_titles": (("books",), "SELECT * FROM (SELECT lower(trim(title)) AS title, count(*) OVER w AS n, min(book_id) OVER w AS first_id, book_id FROM books WHERE trim(title) <> '' WINDOW w AS (PARTITION BY lower(trim(title)))) WHERE n > 1"),
    "G1_full_gaps": (("books",), f"SELECT series, authors, total_owned, array_to_string(owned, ',') AS owned, array_to_string(missing, ',') AS missing FROM {_FULL} WHERE len(missing) > 0"),
    "G3_wishlist": (("books",), f"SELECT series, CAST(v AS INT) AS volume, authors, series || ' #' || CAST(v AS VARCHAR) || ' ' || authors AS query FROM (SELECT series, authors, unnest(missing) AS v FROM {_FULL})"),
    "G2_topology": (("books",), """SELECT series, authors, array_to_string(missing, ',') AS missing, array_to_string(f, ',') AS fractional, 'Missing volumes: ' || array_to_string(missing, ', ') || CASE WHEN len(f) > 0 THEN ' (Contains side novellas: ' || array_to_string(f, ', ') || ')' ELSE '' END AS summary
FROM (SELECT series, authors, f, list_filter(range(CASE WHEN least BETWEEN 2 AND 5 THEN 1 ELSE least END, top + 1), lambda v: NOT list_contains(w, v)) AS missing FROM (SELECT series, coalesce(arg_min(author, (i, book_id)) FILTER (author <> ''), '') AS authors, list(DISTINCT CAST(i AS INT)) FILTER (i = floor(i)) AS w,
  list_sort(coalesce(list(DISTINCT i) FILTER (i <> floor(i)), [])) AS f, min(CAST(i AS INT)) FILTER (i = floor(i)) AS least, max(CAST(i AS INT)) FILTER (i = floor(i)) AS top FROM (SELECT *, CAST(coalesce(series_index, 1) AS DOUBLE) AS i FROM books WHERE series IS NOT NULL) GROUP BY series) WHERE top - least <= 1000) WHERE len(missing) > 0"""),
    "L15_retained": (("runs",), """WITH done AS (SELECT run_id, status, coalesce(finished_at, started_at) AS seen FROM runs WHERE status IN ('completed', 'failed')), open AS (SELECT run_id, status FROM runs WHERE status NOT IN ('completed', 'failed'))
SELECT run_id AS job_id, status FROM open UNION ALL SELECT run_id, status FROM (SELECT *, row_number() OVER (ORDER BY seen DESC, run_id DESC) AS n FROM done WHERE seen >= TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 60 DAY) WHERE n <= 9000 - (SELECT count(*) FROM open)"""),
    "Q12_problematic": (("books_isbn",), f"""SELECT b.book_id AS book_key, action AS status, title, author, series, series_index, CASE WHEN b.book_id % 4 <> 0 THEN flags WHEN b.book_id % 3 <> 0 THEN 'old' ELSE '' END AS flags FROM books_isbn b JOIN ({_ROLLED}) r ON r.book_id = b.book_id
WHERE action IN ('needs_review', 'suggest_fix', 'defer') ORDER BY b.book_id LIMIT 400"""),
    "Q1_inventory": (("books_isbn", "formats"), ORACLES["Q1_inventory"][1].replace("AS blank_language", "AS blank_language, count(*) FILTER (coalesce(trim(publisher), '') = '') AS blank_publisher, count(*) FILTER (coalesce(trim(pubdate), '') = '') AS blank_pubdate, strftime(min(TRY_CAST(last_modified AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS modified_min, strftime(max(TRY_CAST(last_modified AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS modified_max, count(*) FILTER (coalesce(trim(last_modified), '') = '') AS modified_missing, count(*) FILTER (trim(last_modified) <> '' AND TRY_CAST(last_modified AS TIMESTAMP) IS NULL) AS modified_invalid")),
    "Q1_formats": (("formats",), "SELECT format AS value, count(*) AS n FROM formats GROUP BY format"),
    "Q2_manifest": (("books", "formats"), f"SELECT k AS part, h AS manifest FROM {_LEVEL(_LEVEL(_LEVEL(_MANIFEST)))}"),
    "Q3_orphans": (("formats", "candidates", "author_links"), "SELECT link, count(*) AS n_orphans FROM (SELECT 'data' AS link, book_id FROM formats UNION ALL SELECT 'candidates', book_id FROM candidates UNION ALL SELECT 'authors', book_id FROM author_links) WHERE book_id % 50 = 0 GROUP BY link"),
    "Q4_ratings": (("books", "rated"), "SELECT coalesce(printf('%.1f', rating / 2.0), 'unrated') AS stars, count(*) AS n FROM books b LEFT JOIN rated r ON r.book_id = b.book_id GROUP BY 1"),
    "Q5_sort_desyncs": (("books", "author_links"), "SELECT b.book_id, author_sort, canonical FROM books b LEFT JOIN (SELECT book_id, string_agg(sort, ' & ' ORDER BY link_id) AS canonical FROM author_links GROUP BY book_id) l ON l.book_id = b.book_id WHERE author_sort IS NULL OR author_sort <> canonical"),
    "Q6_missing_files": (("formats",), "SELECT book_id, format FROM formats WHERE book_id % 19 = 0"),
    "Q7_bad_titles": (("books",), f"SELECT * FROM (SELECT book_id, title, {_BAD} AS pattern FROM (SELECT book_id, CASE WHEN book_id % 27 = 0 THEN title || ' v1.2' WHEN book_id % 33 = 0 THEN 'Microsoft Word - ' || title ELSE title END AS title FROM books)) WHERE pattern IS NOT NULL"),
    "Q9_summary": (("books", "formats", "rated", "author_links", "cover_stats"), " UNION ALL ".join(_first(n, s) for n, s in {  # noqa: E501
        "bad_titles": f"(SELECT book_id FROM (SELECT book_id, {_BAD} AS p FROM books) WHERE p IS NOT NULL)", "without_formats": "(SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM formats))", "unrated": "(SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM rated))",
        "author_desyncs": "(SELECT book_id FROM books b WHERE author_sort IS NULL OR author_sort <> (SELECT string_agg(sort, ' & ' ORDER BY link_id) FROM author_links a WHERE a.book_id = b.book_id))",
        "duplicate_titles": "(SELECT book_id FROM books WHERE lower(trim(title)) IN (SELECT lower(trim(title)) FROM books WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1))", "missing_files": "(SELECT DISTINCT book_id FROM formats WHERE book_id % 19 = 0)",
        "orphans": "(SELECT DISTINCT book_id FROM author_links WHERE book_id % 80 = 0)", "missing_covers": "(SELECT book_id FROM books WHERE book_id % 9 = 0)",
        "tiny_covers": "(SELECT cover_id AS book_id FROM cover_stats WHERE size_bytes < 4000 OR NOT (width * height > 30000000 OR size_bytes > 15000000) AND (width < 200 OR height < 250))", "huge_covers": "(SELECT cover_id AS book_id FROM cover_stats WHERE size_bytes >= 4000 AND (width * height > 30000000 OR size_bytes > 15000000))",
    }.items())),
    "L5_reset_stale": (("book_states",), "SELECT result_id, CASE WHEN state IN ('shadowed', 'verified', 'review', 'deferred', 'failed', 'source_changed', 'blocked_recovery') THEN state ELSE 'pending' END AS state, state NOT IN ('pending', 'shadowed', 'verified', 'review', 'deferred', 'failed', 'source_changed', 'blocked_recovery') AS reset, state IN ('shadowed', 'verified', 'review', 'deferred', 'failed', 'source_changed', 'blocked_recovery') AND evidence_id IS NOT NULL AS sealed FROM book_states"),
    "L6_depths": (("ledger_operations", "acknowledgements", "pilots", "outbox", "write_locks", "changes"), f"""WITH told AS (SELECT 'outbox' AS kind, status AS state, count(*) AS n, NULL AS most FROM outbox GROUP BY status UNION ALL SELECT 'operations', state, count(*), NULL FROM operations GROUP BY state UNION ALL SELECT 'v2_operations', state, n, NULL FROM {_OPEN}
  UNION ALL SELECT 'changes', status, count(*), NULL FROM changes GROUP BY status UNION ALL SELECT 'pilots', state, sum(reserved), sum(maximum) FROM pilots GROUP BY state UNION ALL SELECT 'incidents', 'acknowledged', count(*), NULL FROM acknowledgements),
known(kind, state) AS (VALUES ('outbox', 'pending'), ('outbox', 'processing'), ('outbox', 'failed'), ('outbox', 'published'), ('operations', 'unknown'), ('operations', 'restore_failed'), ('changes', 'failed_rollback_failed'), ('pilots', 'open'), ('pilots', 'stopped'), ('pilots', 'completed'),
  ('v2_operations', 'requested'), ('v2_operations', 'claimed'), ('v2_operations', 'writing'), ('v2_operations', 'verifying'), ('v2_operations', 'restoring'), ('v2_operations', 'succeeded'), ('v2_operations', 'restored'), ('v2_operations', 'restore_failed'), ('v2_operations', 'unknown'), ('v2_operations', 'failed'), ('v2_operations', 'cancelled'))
SELECT kind, state, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(most, CASE WHEN kind = 'pilots' THEN 0 END) AS BIGINT) AS most FROM known FULL JOIN told USING (kind, state)"""),
    "L7_open_depth": (("ledger_operations", "acknowledgements", "pilots", "outbox", "write_locks"), f"SELECT * FROM {_OPEN}"),
    "L8_run_depth": (("all_runs",), """WITH own AS (SELECT * FROM all_runs WHERE contract_version = 'certificate-a-v1' AND pipeline_version = 'manifestation-v2'), o AS (SELECT min(coalesce(heartbeat_at, started_at)) AS oldest FROM own WHERE status IN ('pending', 'inventorying', 'running', 'cancelling'))
SELECT k.status, (SELECT count(*) FROM own WHERE own.status = k.status) AS n, strftime(oldest, '%Y-%m-%d %H:%M:%S') AS oldest_active, CAST(coalesce(epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(oldest), 0) AS BIGINT) AS age_s
FROM (SELECT unnest(['pending', 'inventorying', 'running', 'cancelling', 'cancelled', 'completed', 'completed_with_errors', 'failed', 'source_changed', 'blocked_recovery']) AS status) k, o"""),
    "L16_read_back": (("current_fields",), """WITH e AS (SELECT book_id, CASE WHEN book_id % 4 <> 0 THEN 'ed ' || CAST(book_id AS VARCHAR) END AS v FROM current_fields WHERE field = 'title'),
r AS (SELECT book_id, coalesce(nullif(CASE WHEN book_id % 7 BETWEEN 1 AND 3 THEN v END, ''), CASE WHEN book_id % 3 <> 0 THEN CASE WHEN book_id % 5 = 0 THEN 'other' ELSE v END END, '') AS seen, coalesce(v, '') AS want FROM e),
s AS (SELECT book_id, value IS NOT DISTINCT FROM CASE WHEN book_id % 6 = 0 AND field = 'title' THEN upper(value) ELSE value END AS same FROM current_fields UNION ALL SELECT book_id, seen = want FROM r)
SELECT book_id, bool_and(same) AS matches, count(*) FILTER (NOT same) AS n_differ FROM s GROUP BY book_id"""),
    "Q14_run_metrics": (("run_books", "run_starts"), """WITH l AS (SELECT run_id FROM run_starts ORDER BY created_at DESC, run_id DESC LIMIT 1), b AS (SELECT * FROM run_books JOIN l USING (run_id))
SELECT run_id, status, count(*) AS n, (SELECT count(*) FROM b) AS total, (SELECT string_agg(CAST(book_key AS VARCHAR), ',' ORDER BY book_key) FROM (SELECT book_key FROM b ORDER BY book_key LIMIT 5)) AS sample_keys FROM b GROUP BY run_id, status"""),
    "X12_private_parts": (("message_parts",), "SELECT message_id, CAST(0 AS BIGINT) AS text_chars, CAST(0 AS BIGINT) AS image_count, sha256(string_agg('text:[HIDDEN FOR PRIVACY]', chr(10)) FILTER (kind = 'text')) AS payload_sha256 FROM message_parts GROUP BY message_id"),
    "X12_sent_parts": (("message_parts",), "SELECT message_id, CAST(coalesce(sum(length(content)) FILTER (kind = 'text'), 0) AS BIGINT) AS text_chars, count(*) FILTER (kind = 'image') AS image_count, sha256(string_agg(kind || ':' || coalesce(content, ''), chr(10) ORDER BY seq)) AS payload_sha256 FROM message_parts GROUP BY message_id"),
    "Q10_page": (("books",), "SELECT book_id, title, author FROM books ORDER BY book_id DESC LIMIT 40 OFFSET 25"),
    "Q11_latest": (("operations",), "SELECT book_key, operation_id, state FROM (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY created_at DESC, operation_id DESC) AS n FROM operations) WHERE n = 1"),
    "Q13_review_listing": (("evidence", "format_evidence"), f"{_WITH_ROOTS} SELECT book_id, reason FROM {_LADDER} WHERE tier = 'C'"),
    "Q15_action_shares": (("books_isbn",), f"SELECT what, count(*) AS n, round(avg(CAST(eligible AS INT)), 6) AS eligible_share FROM (SELECT 'action:' || action AS what, eligible FROM ({_ROLLED}) UNION ALL SELECT 'flag:' || unnest(string_split(flags, ',')), eligible FROM ({_ROLLED}) WHERE flags <> '') GROUP BY what"),
    "Q16_metrics": (("requests",), "SELECT 'http_seconds' AS name, 'route=' || route || ',status=' || CAST(status AS VARCHAR) AS labels, round(sum(duration_s), 4) AS total, count(*) AS n, arg_max(duration_s, {'t': ts, 'e': event_id}) AS last FROM requests GROUP BY route, status"),
    "Q18_review_deck": (("cover_stats",), f"SELECT * FROM ({ORACLES['P3_P6_cover_quality'][1]}) WHERE cover_id > 30 AND (actionable OR cqs < 60) ORDER BY cover_id LIMIT 60"),
    "K3_full_gate": (("calibration",), " UNION ALL ".join((_case(0, _FAILS.format("")), _case(1, _FAILS.format(", 'expired', 'too_old'")), _case(2, _FAILS.format(", 'in_the_future'")), _case(3, "'disabled'"), _case(9, "'seal_invalid'")))),
    "K4_sealed_report": (("calibration",), f"SELECT *, {_SEAL} AS seal FROM {_GATE}"),
    "L2_resumable": (("books", "operations"), "SELECT book_id AS book_key FROM books WHERE book_id NOT IN (SELECT book_key FROM operations WHERE state = 'succeeded' AND operation_id % 5 <> 0)"),
    "L3_membership": (("operations",), "SELECT * FROM (SELECT book_key, count(*) FILTER (operation_id % 3 <> 0) AS stored, count(*) FILTER (operation_id % 4 <> 0) AS frozen FROM operations GROUP BY book_key) WHERE stored <> frozen"),
    "L11_L12_approvals": (("books_isbn",), f"""SELECT book_id, p AS patch, CASE WHEN book_id % 3 = 0 AND book_id % 9 <> 0 AND book_id % 15 <> 0 AND p = patch THEN 'auth-' || CAST(book_id AS VARCHAR) || 'b' END AS authorization_id, CASE WHEN p <> '' AND (ok OR (book_id % 3 = 0 AND book_id % 9 <> 0 AND book_id % 15 <> 0 AND p = patch)) THEN 'queued' ELSE 'skipped' END AS outcome
FROM (SELECT *, eligible AND confidence >= 80 AS ok, array_to_string(list_sort(list_filter(string_split(patch, ','), lambda z: z <> '' AND NOT (z = 'language' AND book_id % 4 = 0))), ',') AS p FROM ({_ROLLED})) WHERE action = 'suggest_fix'"""),
    "L13_expired": (("operations",), "SELECT operation_id, created_at FROM operations WHERE created_at < TIMESTAMP '1995-05-02 00:00:00'"),
    "L14_heartbeats": (("runs",), "SELECT run_id AS owner, coalesce(status = 'completed' AND heartbeat_at <= TIMESTAMP '1995-01-01 00:00:00' AND heartbeat_at >= TIMESTAMP '1995-01-01 00:00:00' - INTERVAL 300 DAY, FALSE) AS fresh FROM runs"),
    "P1_P2_histograms": (("histograms",), "SELECT cover_id, round(e, 6) AS entropy, round(CASE WHEN s < 20 THEN 6.0E0 ELSE least(25.0E0, s / 75 * 25) END, 6) AS contrast FROM (SELECT cover_id, -sum(n / t * log2(n / t)) AS e, sqrt(greatest(0.0E0, sum(n / t * bin * bin) - pow(sum(n / t * bin), 2))) AS s FROM (SELECT cover_id, CAST(bin AS DOUBLE) AS bin, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY cover_id) AS DOUBLE) AS t FROM histograms) GROUP BY cover_id)"),
    "P7_spurious": (("cover_stats",), f"SELECT cover_id, CASE WHEN dominant_ratio > 0.98 THEN 'blank_canvas' ELSE 'interior_page_scan' END AS defect, CASE WHEN dominant_ratio > 0.98 THEN dominant_ratio WHEN contains(o, 'chapter') THEN 0.98E0 WHEN entropy BETWEEN 1.2 AND 3.5 THEN 0.92E0 ELSE 0.85E0 END AS confidence FROM {_SPURIOUS} WHERE dominant_ratio > 0.98 OR inside"),
    "P8_forensics": (("cover_spectra",), "SELECT cover_id, " + _P8.format(*map(_q, ("dense_text_reading_page", "marginal_folio_with_dense_lines", "periodic_paragraph_lines", "monochrome_or_blank_placeholder", "distorted_aspect_ratio", "critically_low_resolution"))) + " AS reason, round(" + _P8.format("least(0.99E0, 0.7E0 + her / 20 + acf)", "0.95E0", "0.9E0", "0.95E0", "0.85E0", "0.8E0") + ", 6) AS confidence FROM cover_spectra"),
    "P9_changed": (("cover_stats",), "SELECT cover_id, cover_id * 1000 AS mtime, cover_id % 10 = 0 OR cover_id % 7 = 0 AS due FROM cover_stats"),
    "E3_open_embeddings": (("snippets",), "SELECT sha256('p|m|' || text) AS request_hash, count(*) AS n_requests FROM snippets WHERE text NOT IN (SELECT text FROM snippets WHERE book_id % 3 = 0) GROUP BY text"),
}

_WINDOWS = "(SELECT start_s, count(*) AS n, count(*) FILTER (status >= 500) AS errors, sum(duration_s) AS seconds FROM (SELECT status, duration_s, unnest(range(CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 - 240, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 + 1, 60)) AS start_s FROM requests) GROUP BY start_s)"
_KEPT = "(SELECT book_id, title FROM books WHERE book_id % 25 <> 0 OR book_id NOT IN (SELECT book_id FROM identifiers GROUP BY book_id, lower(type) HAVING count(DISTINCT value) > 1))"
_AUTHORS = "(SELECT book_id, string_agg(sort, '{}' ORDER BY link_id) AS authors FROM author_links GROUP BY book_id)"
_HELD = "(SELECT book_id, string_agg(format, ',' ORDER BY format) AS formats FROM formats GROUP BY book_id)"
_own_isbn = canonical("coalesce(isbn, '')")

def _larger(u: str, size: str) -> str:
    b = f"replace(replace(replace(replace({u}, 'http://', 'https://'), '&edge=curl', ''), 'edge=curl&', ''), 'edge=curl', '')"
    return f"regexp_replace(CASE WHEN contains({b}, 'zoom=1') THEN replace({b}, 'zoom=1', 'zoom=0') WHEN contains({b}, 'zoom=5') THEN replace({b}, 'zoom=5', 'zoom=0') WHEN NOT contains({b}, 'zoom=') AND contains({b}, '?') THEN {b} || '&zoom=0' ELSE {b} END, 'fife=w\\d+-h\\d+', 'fife={size}', 'g')"


_tag = lambda n: f"nullif(trim(replace(regexp_extract(xml, '<{n}>([^<]*)</{n}>', 1), '&amp;', '&')), '')"
_code_of = lambda n: f"upper(regexp_replace(coalesce({_tag(n)}, ''), '[^0-9Xx]', '', 'g'))"
#: The patterns and lists again, so that a change of the operators' own shows.
_CODE = "'(?:ISBN(?:-1[03])?\\s*[: ]\\s*)([0-9Xx][0-9Xx\\s-]{8,20}[0-9Xx])'"
_TAGGED = "'\\b(?:ISBN(?:-1[03])?[:\\s]*)?((?:97[89][-\\s]?(?:\\d[-\\s]?){9}\\d)|(?:\\d[-\\s]?(?:\\d[-\\s]?){8}[\\dXx]))\\b(?:\\s*\\(([^)]+)\\))?'"
_LAID = "'\\b(?:D\\.?\\s*L\\.?|Dep[óo]sito\\s+Legal)[\\s:]*([A-Z]{1,4}|[A-Z]{1,2}-[A-Za-z]+)?[-\\s.]*(\\d{1,6}(?:\\.\\d{3})?)[-\\s/]*((?:19|20)\\d{2}|\\d{2})\\b'"
_HOUSE = "'(?:Publicado por|Published by|Editorial|Ediciones)\\s+([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ\\s&.,''-]+?)(?:\\r?\\n|,|\\.)'"
_CIP = "['cataloging-in-publication', 'cataloging in publication', 'library of congress', 'depósito legal', 'deposito legal', 'd.l.', 'dépôt légal', 'todos los derechos reservados', 'all rights reserved', 'tous droits réservés', 'primera edición', 'first edition', 'impreso en', 'printed in', 'copyright ©']"
_END = "['se terminó de imprimir', 'se termino de imprimir', 'acabose de imprimir', 'achevé d''imprimer', 'talleres de', 'talleres gráficos', 'colofón', 'colofon']"
_IN_CONTEXT = f"""(SELECT DISTINCT book_id, isbn13 FROM (SELECT book_id, {canonical("code")} AS isbn13 FROM (SELECT book_id, upper(regexp_replace(unnest(regexp_extract_all(text, {_CODE}, 1, 'i')), '[^0-9Xx]', '', 'g')) AS code FROM imprints
  WHERE source = 'copyright_page' OR seq < 6 AND regexp_matches(lower(text), 'copyright|colophon|published by'))) WHERE isbn13 IS NOT NULL)"""
_GUESSES = """(SELECT book_id, CASE WHEN contains(head, ' by ') THEN trim(split_part(head, ' by ', 1)) ELSE head END AS title, CASE WHEN contains(head, ' by ') THEN trim(substr(head, strpos(head, ' by ') + 4)) ELSE rest[1] END AS author
FROM (SELECT book_id, lines[1] AS head, list_filter(lines[2:5], lambda x: NOT regexp_matches(lower(x), 'isbn|translated|titles by|arcade publishing')) AS rest FROM (SELECT book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM imprints WHERE source = 'title_page') WHERE len(lines) > 0))"""
_IMPRINT = f"""(SELECT book_id, arg_min(deposit, seq) FILTER (deposit IS NOT NULL) AS deposit, arg_min(house, seq) FILTER (house IS NOT NULL) AS publisher, arg_min(year, seq) FILTER (year IS NOT NULL) AS year FROM (
  SELECT book_id, seq, CASE WHEN y <> '' THEN regexp_replace(concat_ws('-', place, replace(number, '.', ''), whole), '^-+|-+$', '', 'g') END AS deposit, CASE WHEN length(house) > 3 AND NOT regexp_matches(lower(house), 'autor|traductor|isbn') THEN house END AS house, coalesce(TRY_CAST(whole AS INT), list_max(years)) AS year
  FROM (SELECT *, CASE WHEN length(y) = 2 AND CAST(y AS INT) < 50 THEN '20' || y ELSE y END AS whole FROM (SELECT book_id, seq, regexp_extract(text, {_LAID}, 1, 'i') AS place, regexp_extract(text, {_LAID}, 2, 'i') AS number, regexp_extract(text, {_LAID}, 3, 'i') AS y, trim(regexp_extract(text, {_HOUSE}, 1, 'i')) AS house,
    list_filter(list_transform(regexp_extract_all(text, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda z: CAST(z AS INT)), lambda z: z BETWEEN 1800 AND 2030) AS years FROM imprints))) GROUP BY book_id)"""

ORACLES |= {
    "T3_slow_windows": (("requests",), f"SELECT start_s, n, round(seconds / n, 6) AS mean_s FROM {_WINDOWS} WHERE seconds / n > 0.4"),
    "T4_held_alerts": (("requests",), f"SELECT 'errors' AS rule, start_s, since_s FROM (SELECT start_s, min(start_s) OVER (PARTITION BY island) AS since_s FROM (SELECT start_s, start_s - 60 * row_number() OVER (ORDER BY start_s) AS island FROM {_WINDOWS} WHERE errors / n > 0.01)) WHERE start_s - since_s >= 240"),
    "T5_stalled_runs": (("runs",), "SELECT run_id, 851000000 - CAST(floor(epoch(coalesce(heartbeat_at, started_at))) AS BIGINT) AS age_s FROM runs WHERE status IN ('pending', 'running') AND 851000000 - floor(epoch(coalesce(heartbeat_at, started_at))) > 600"),
    "T6_once": (("requests",), "SELECT event_id, route, status FROM requests"),
    "T7_cooling": (("requests",), "SELECT * FROM (SELECT event_id, identity, at_s - max(CASE WHEN status >= 500 THEN at_s END) OVER (PARTITION BY identity ORDER BY at_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_s FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM requests)) WHERE after_s <= 7200"),
    "T8_status_changes": (("requests",), "SELECT route, CAST(floor(at_s / 60) AS BIGINT) * 60 - 60 * k AS start_s, count(*) AS changes FROM (SELECT route, at_s, status, lag(status) OVER (PARTITION BY route ORDER BY at_s, event_id) AS before FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM requests)), range(10) AS r(k) WHERE before <> status GROUP BY ALL"),
    "T1_rate_limit": (("requests",), """WITH RECURSIVE r AS (SELECT event_id, identity, at_s, row_number() OVER (PARTITION BY identity ORDER BY at_s, event_id) AS k FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM requests)),
w(identity, k, event_id, at_s, start_s, n) AS (SELECT identity, k, event_id, at_s, at_s, 1 FROM r WHERE k = 1 UNION ALL
  SELECT r.identity, r.k, r.event_id, r.at_s, CASE WHEN r.at_s >= w.start_s + 21600 THEN r.at_s ELSE w.start_s END, CASE WHEN r.at_s >= w.start_s + 21600 THEN 1 ELSE w.n + 1 END FROM w JOIN r ON r.identity = w.identity AND r.k = w.k + 1)
SELECT event_id, CASE WHEN n > 3 THEN start_s + 21600 - at_s ELSE 0 END AS wait_s FROM w"""),
    "T4_transitions": (("requests",), f"""WITH e AS (SELECT start_s + 299 AS at_s, errors / n > 0.01 AS met FROM {_WINDOWS}), g AS (SELECT *, count_if(NOT met) OVER (ORDER BY at_s) AS island FROM e),
runs AS (SELECT island, min(at_s) AS since_s FROM g WHERE met GROUP BY island), ends AS (SELECT island - 1 AS island, at_s AS end_s FROM g WHERE NOT met),
fired AS (SELECT * FROM runs LEFT JOIN ends USING (island) WHERE end_s > since_s + 240 OR end_s IS NULL AND since_s + 240 <= (SELECT max(at_s) FROM e))
SELECT 'errors' AS rule, 'firing' AS state, since_s + 240 AS at_s, since_s FROM fired UNION ALL SELECT 'errors', 'resolved', end_s, since_s FROM fired WHERE end_s IS NOT NULL"""),
    "T10_worker_sessions": (("heartbeats",), """WITH b AS (SELECT worker, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, coalesce(ts >= lag(ts) OVER w + INTERVAL 120 SECOND, TRUE) AS opens, ts FROM heartbeats WINDOW w AS (PARTITION BY worker ORDER BY ts)),
s AS (SELECT worker, at_s, count_if(opens) OVER (PARTITION BY worker ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM b)
SELECT worker, min(at_s) AS start_s, max(at_s) AS last_s, count(*) AS beats FROM s GROUP BY worker, n"""),
    "T9_running_counts": (("operations",), "SELECT operation_id % 7 AS run_id, state AS action, count(*) AS n FROM operations GROUP BY 1, 2"),
    "X1_stripped": ((), r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'gsi'), '<[^>]*>', '', 'gs'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS text FROM pages""".replace("\\\\", "\\")),
    "X10_budgeted": (("imprints",), "SELECT book_id, seq, source, substr(text, 1, CAST(greatest(60 - before, 0) AS BIGINT)) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM imprints WHERE seq < 2) WHERE before < 60"),
    "X3_context_isbns": (("imprints",), f"SELECT * FROM {_IN_CONTEXT}"),
    "X4_content_identifier": (("books_isbn", "imprints"), f"""SELECT b.book_id, coalesce(one, isbn) AS identifier, CASE WHEN one IS NOT NULL THEN 'content' WHEN isbn IS NOT NULL THEN 'embedded' END AS origin
FROM books_isbn b LEFT JOIN (SELECT book_id, CASE WHEN count(*) = 1 THEN min(isbn13) END AS one FROM {_IN_CONTEXT} GROUP BY book_id) x USING (book_id)"""),
    "X5_guesses": (("imprints",), f"SELECT * FROM {_GUESSES}"),
    "X6_edition_pages": (("imprints",), f"""WITH p AS (SELECT book_id, seq, len(list_filter({_CIP}, lambda m: contains(lower(text), m))) > 0 AS c, len(list_filter({_END}, lambda m: contains(lower(text), m))) > 0 AS e, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 100 AS few FROM imprints),
a AS (SELECT book_id, min(seq) AS copyright_seq FROM p WHERE c GROUP BY book_id), b AS (SELECT p.book_id, min(seq) AS colophon_seq FROM p LEFT JOIN a ON a.book_id = p.book_id AND a.copyright_seq = p.seq WHERE e AND a.book_id IS NULL GROUP BY p.book_id),
t AS (SELECT p.book_id, min(seq) AS title_seq FROM p LEFT JOIN b ON b.book_id = p.book_id AND b.colophon_seq = p.seq WHERE NOT c AND few AND seq <= 2 AND b.book_id IS NULL GROUP BY p.book_id)
SELECT * FROM a FULL JOIN b USING (book_id) FULL JOIN t USING (book_id)"""),
    "X7_tagged_isbns": (("imprints",), f"""WITH m AS (SELECT book_id, seq, unnest(x) AS hit, generate_subscripts(x, 1) AS pos FROM (SELECT book_id, seq, regexp_extract_all(text, {_TAGGED}, 0, 'i') AS x FROM imprints)),
n AS (SELECT book_id, seq, pos, {canonical("code")} AS isbn13, nullif(lower(trim(regexp_extract(hit, {_TAGGED}, 2, 'i'))), '') AS tag FROM (SELECT *, upper(regexp_replace(regexp_extract(hit, {_TAGGED}, 1, 'i'), '[^0-9Xx]', '', 'g')) AS code FROM m)),
by_code AS (SELECT book_id, isbn13, last(tag ORDER BY seq, pos) AS tag, min((seq, pos)) AS place FROM n WHERE isbn13 IS NOT NULL GROUP BY book_id, isbn13)
SELECT book_id, isbn13, tag, row_number() OVER (PARTITION BY book_id ORDER BY NOT coalesce(regexp_matches(tag, 'epub|digital|ebook'), FALSE), place) = 1 AS is_primary FROM by_code"""),
    "X8_X9_imprint": (("imprints",), f"SELECT * FROM {_IMPRINT}"),
    "X11_observations": (("books", "imprints"), f"""SELECT b.book_id, coalesce(g.title, observed_title) AS title, coalesce(g.author, b.author) AS author, coalesce(i.publisher, b.publisher) AS publisher, year, CASE WHEN n > 500 THEN 'high' ELSE 'medium' END AS quality FROM books b
LEFT JOIN (SELECT * FROM {_GUESSES} WHERE book_id % 4 <> 0) g ON g.book_id = b.book_id LEFT JOIN (SELECT * FROM {_IMPRINT} WHERE book_id % 4 <> 0) i ON i.book_id = b.book_id LEFT JOIN (SELECT book_id, sum(length(text)) AS n FROM imprints WHERE book_id % 4 <> 0 GROUP BY book_id) s ON s.book_id = b.book_id"""),
    "X12_egress": (("snippets",), "SELECT book_id, CASE WHEN book_id % 3 = 0 THEN CAST(sum(length(text)) AS BIGINT) ELSE 0 END AS text_chars, sha256(string_agg(CASE WHEN book_id % 3 = 0 THEN text ELSE '[text withheld]' END, chr(10) ORDER BY seq)) AS payload_sha256 FROM snippets GROUP BY book_id"),
    "I1_wide_books": (("books", "author_links", "identifiers", "formats"), f"""SELECT b.book_id, title, authors, '{{' || '"goodreads":"' || CAST(b.book_id * 7 AS VARCHAR) || '"' || CASE WHEN v IS NOT NULL THEN ',"isbn":"' || v || '"' ELSE '' END || '}}' AS identifiers, formats
FROM {_KEPT} b LEFT JOIN {_AUTHORS.format('|')} a ON a.book_id = b.book_id LEFT JOIN (SELECT book_id, min(value) AS v FROM identifiers WHERE lower(type) = 'isbn' GROUP BY book_id) i ON i.book_id = b.book_id LEFT JOIN {_HELD} f ON f.book_id = b.book_id"""),
    "I1_rejects": (("identifiers",), "SELECT book_id, 'identifier:isbn' AS reason FROM identifiers WHERE lower(type) = 'isbn' GROUP BY book_id HAVING count(DISTINCT value) > 1"),
    "I2_flat_books": (("books", "author_links", "identifiers", "formats"), f"SELECT b.book_id, title, authors, coalesce(formats, '') AS formats, v AS isbn FROM {_KEPT} b LEFT JOIN {_AUTHORS.format(' & ')} a ON a.book_id = b.book_id LEFT JOIN (SELECT book_id, min(value) AS v FROM identifiers WHERE lower(type) = 'isbn' GROUP BY book_id) i ON i.book_id = b.book_id LEFT JOIN {_HELD} f ON f.book_id = b.book_id"),
    "I3_scanned": (("books",), "SELECT book_id AS book_key, CASE WHEN book_id % 4 <> 0 THEN upper(title) ELSE title END AS title, CASE WHEN book_id % 4 <> 0 THEN 'xx' ELSE language END AS language, CASE WHEN book_id % 4 <> 0 THEN 'scanned' ELSE 'verified' END AS status FROM books WHERE book_id % 12 <> 0"),
    "I4_unseen": (("formats",), "SELECT DISTINCT '/library/' || CAST(book_id AS VARCHAR) || '.' || lower(format) AS path FROM formats WHERE book_id % 6 <> 0 AND book_id % 10 <> 5"),
    "I8_inserted": (("evidence",), "SELECT CAST(book_id AS VARCHAR) || '/' || independence_root || '/' || field AS evidence_id, CASE WHEN book_id % 2 = 0 THEN 'conflict' ELSE 'inserted' END AS outcome FROM evidence WHERE book_id % 2 = 1 OR book_id % 10 = 0"),
    "I9_report": (("pairs",), f"""SELECT book_id, '[' || string_agg('{{"field":"' || field || '","verdict":"' || verdict || '","confidence":' || CAST(confidence AS VARCHAR) || '}}', ',' ORDER BY field) || ']' AS verdicts FROM {_SETTLED} GROUP BY book_id"""),
    "I10_of_types": ((), "SELECT doc_id FROM documents WHERE lang IN ('en', 'de')"),
    "N19_N20_cover_urls": (("addresses",), f"""SELECT book_id, pos, CASE WHEN thumbnail <> '' THEN CASE WHEN contains(a, 'fife=') THEN a ELSE a || CASE WHEN contains(a, '?') THEN '&' ELSE '?' END || 'fife=w1600-h2400' END WHEN volume <> '' THEN 'https://books.google.com/books/publisher/content/images/frontcover/' || volume || '?fife=w1600-h2400' END AS large,
  CASE WHEN thumbnail <> '' THEN b WHEN volume <> '' THEN 'https://books.google.com/books/publisher/content/images/frontcover/' || volume || '?fife=w1000-h1500' END AS by_volume, CASE WHEN cover_id <> 0 THEN 'https://covers.openlibrary.org/b/id/' || CAST(cover_id AS VARCHAR) || '-L.jpg?default=false' ELSE i END AS by_number, i AS by_isbn,
  'https://images-na.ssl-images-amazon.com/images/P/B' || upper(isbn13) || '.01._SL1600_.jpg' AS shop, lower(split_part(address, '://', 1)) = 'https' AND NOT contains(address, '@') AND lower(regexp_extract(address, '//([^/:]+)', 1)) IN ('openlibrary.org', 'covers.openlibrary.org') AND NOT contains(split_part(address, '/', 3), ':8443') AS allowed
FROM (SELECT *, {_larger('thumbnail', 'w1600-h2400')} AS a, {_larger('thumbnail', 'w1000-h1500')} AS b, 'https://covers.openlibrary.org/b/isbn/' || ({canonical("coalesce(isbn13, '')")}) || '-L.jpg?default=false' AS i FROM addresses)"""),
    "I5_volumes": (("volume_payloads",), f"""WITH i AS (SELECT book_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM (SELECT book_id, CAST(CASE WHEN json_valid(payload) THEN payload -> '$.items' END AS JSON[]) AS xs FROM volume_payloads) WHERE xs IS NOT NULL),
p AS (SELECT *, x -> '$.volumeInfo' AS v, coalesce(nullif(x ->> '$.volumeInfo.imageLinks.thumbnail', ''), x ->> '$.volumeInfo.imageLinks.smallThumbnail') AS picture FROM i)
SELECT book_id, CAST(pos AS INT) AS pos, 'google_books:' || (x ->> '$.id') AS candidate_id, x ->> '$.selfLink' AS provider_url, v ->> '$.title' AS title, array_to_string(CAST(v -> '$.authors' AS VARCHAR[]), ' & ') AS authors, v ->> '$.publisher' AS publisher, v ->> '$.publishedDate' AS published, v ->> '$.language' AS language,
  list_filter(CAST(v -> '$.industryIdentifiers' AS JSON[]), lambda z: contains(lower(z ->> '$.type'), 'isbn'))[-1] ->> '$.identifier' AS isbn, CASE WHEN picture <> '' THEN {_larger('picture', 'w1000-h1500')} ELSE 'https://books.google.com/books/publisher/content/images/frontcover/' || (x ->> '$.id') || '?fife=w1000-h1500' END AS cover_url FROM p"""),
    "I5_search_docs": (("search_payloads",), """WITH i AS (SELECT book_id, unnest(xs[:5]) AS x, generate_subscripts(xs[:5], 1) - 1 AS pos FROM (SELECT book_id, CAST(CASE WHEN json_valid(payload) THEN payload -> '$.docs' END AS JSON[]) AS xs FROM search_payloads) WHERE xs IS NOT NULL)
SELECT book_id, CAST(pos AS INT) AS pos, 'openlibrary:' || string_split(x ->> '$.key', '/')[-1] AS candidate_id, x ->> '$.title' AS title, array_to_string(CAST(x -> '$.author_name' AS VARCHAR[]), ' & ') AS authors, x ->> '$.publisher[0]' AS publisher, x ->> '$.language[0]' AS language, x ->> '$.isbn[0]' AS isbn,
  nullif(x ->> '$.first_publish_year', '0') AS published, 'https://covers.openlibrary.org/b/id/' || nullif(x ->> '$.cover_i', '0') || '-L.jpg' AS cover_url FROM i"""),
    "I5_book_records": (("record_payloads",), f"""WITH r AS (SELECT book_id, code, CASE WHEN json_valid(payload) THEN json_extract(payload, '$."ISBN:' || code || '"') END AS x FROM (SELECT *, {canonical("coalesce(isbn, '')")} AS code FROM record_payloads) WHERE code IS NOT NULL),
f AS (SELECT book_id, code, x ->> '$.url' AS source_url, unnest([{{'f': 'identifiers', 'v': code}}, {{'f': 'title', 'v': x ->> '$.title'}}, {{'f': 'authors', 'v': nullif(array_to_string(list_filter(list_transform(CAST(x -> '$.authors' AS JSON[]), lambda a: a ->> '$.name'), lambda n: n <> ''), ' & '), '')}},
  {{'f': 'publisher', 'v': x ->> '$.publishers[0].name'}}, {{'f': 'languages', 'v': nullif(array_to_string(list_transform(CAST(x -> '$.languages' AS JSON[]), lambda a: lower(string_split(a ->> '$.key', '/')[-1])), ';'), '')}}, {{'f': 'pubdate', 'v': x ->> '$.publish_date'}}, {{'f': 'cover', 'v': x ->> '$.cover.large'}}]) AS e FROM r WHERE x IS NOT NULL)
SELECT 'ev_' || substr(sha256(encode('openlibrary:' || code) || '\\x00'::BLOB || encode(e.f)), 1, 20) AS evidence_id, book_id, e.f AS field, e.v AS value, source_url FROM f WHERE e.v IS NOT NULL"""),
    "I6_series_matches": (("match_payloads",), """WITH t AS (SELECT book_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM match_payloads),
m AS (SELECT book_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.candidates') THEN CASE WHEN json_type(j -> '$.candidates') = 'ARRAY' THEN CAST(j -> '$.candidates' AS JSON[]) END WHEN json_type(j) = 'OBJECT' THEN [j] END AS xs FROM t),
i AS (SELECT book_id, unnest(xs[:3]) AS x, generate_subscripts(xs[:3], 1) - 1 AS pos FROM m WHERE xs IS NOT NULL),
n AS (SELECT *, nullif(x ->> '$.title', '') AS t, nullif(x ->> '$.name', '') AS n, nullif(x ->> '$.series', '') AS s, x ->> '$.volume' AS v, CASE WHEN (x ->> '$.chapter') <> '' AND (json_type(x -> '$.chapter') = 'VARCHAR' OR TRY_CAST(x ->> '$.chapter' AS DOUBLE) <> 0) THEN x ->> '$.chapter' ELSE x ->> '$.number' END AS c FROM i WHERE json_type(x) = 'OBJECT')
SELECT book_id, CAST(pos AS INT) AS pos, coalesce(t, n) AS title, coalesce(s, t) AS series, CASE WHEN json_type(x -> '$.volume') = 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN TRY_CAST(trim(v) AS INT) END ELSE CAST(trunc(TRY_CAST(v AS DOUBLE)) AS INT) END AS volume,
  TRY_CAST(c AS DOUBLE) AS chapter, coalesce(TRY_CAST(x ->> '$.series_position' AS DOUBLE), TRY_CAST(c AS DOUBLE)) AS series_position FROM n WHERE coalesce(t, n, s) IS NOT NULL"""),
    "I7_comic_records": (("sidecars",), f"""SELECT book_id, {_tag('Title')} AS title, {_tag('Series')} AS series, TRY_CAST({_tag('Number')} AS DOUBLE) AS series_index, TRY_CAST({_tag('Volume')} AS INT) AS volume, TRY_CAST({_tag('Chapter')} AS DOUBLE) AS chapter,
  array_to_string(list_filter(list_transform(string_split(coalesce({_tag('Writer')}, ''), ','), lambda z: trim(z)), lambda z: z <> ''), ' & ') AS authors, {_tag('Publisher')} AS publisher, {_tag('Year')} || '-' || lpad(coalesce({_tag('Month')}, '01'), 2, '0') || '-01' AS published,
  array_to_string(list_filter(list_transform(string_split({_tag('Genre')}, ','), lambda z: trim(z)), lambda z: z <> ''), '|') AS tags FROM sidecars"""),
    "I11_opf_records": (("opf_bodies",), r"""WITH r AS (SELECT book_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM (SELECT book_id, list_filter(string_split(body, '<?xml'), lambda z: contains(z, '<package')) AS xs FROM opf_bodies))
SELECT book_id, CAST(pos AS INT) AS pos, nullif(regexp_extract(x, '<dc:title>([^<]*)<', 1), '') AS title, array_to_string(regexp_extract_all(x, '<dc:creator>([^<]*)<', 1), ' & ') AS authors, nullif(regexp_extract(x, '<dc:publisher>([^<]*)<', 1), '') AS publisher, nullif(substr(regexp_extract(x, '<dc:date>([^<]*)<', 1), 1, 10), '') AS published,
  nullif(regexp_extract(x, '<dc:language>([^<]*)<', 1), '') AS language, nullif(regexp_extract(x, '<dc:identifier opf:scheme="(?i:isbn)">([^<]*)<', 1), '') AS isbn FROM r"""),
    "I12_comic_evidence": (("sidecars",), f"""SELECT substr(sha256(CAST(book_id AS VARCHAR) || '|' || e.f), 1, 20) AS evidence_id, book_id, e.f AS field, e.v AS value FROM (SELECT book_id, unnest([{{'f': 'title', 'v': {_tag('Title')}}}, {{'f': 'authors', 'v': array_to_string(list_filter(list_transform(regexp_split_to_array({_tag('Writer')}, '[;&]'), lambda z: trim(z)), lambda z: z <> ''), ' & ')}},
  {{'f': 'languages', 'v': lower({_tag('LanguageISO')})}}, {{'f': 'identifiers', 'v': coalesce({canonical(_code_of('GTIN'))}, {canonical(_code_of('ISBN'))})}}]) AS e FROM sidecars) WHERE e.v <> ''"""),
    "I13_provider_order": (("candidates",), "SELECT book_id, title, provider, CASE provider WHEN 'google_books' THEN 0 WHEN 'openlibrary' THEN 1 ELSE 2 END AS pos FROM candidates"),
}
