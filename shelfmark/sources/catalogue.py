"""Catalogue inputs derived from the star-schema tables, as SQL that Spark and DuckDB both run.

Each view names the views it stands on; `sql` puts the needed ones in front as
common table expressions, so Catalyst prunes columns and pushes filters
through to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")



def _text_or_null(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE concat('\"', {c}, '\"') END"


def _volume(k: int) -> str:
    """One item of a volumes payload, with parts that vary or lack."""
    n, isbn = f"(book_id + {k})", "coalesce(isbn, '0306406152')"
    return f"""concat('{{"id": "v', CAST(book_id AS STRING), '-{k}", "selfLink": "https://s/', CAST(book_id AS STRING), '", "volumeInfo": {{"title": ', {_text_or_null('title')},
    CASE {n} % 4 WHEN 0 THEN '' WHEN 1 THEN concat(', "authors": ["', author, '"]') ELSE concat(', "authors": ["', author, '", "Plato"]') END, CASE WHEN {n} % 5 = 0 THEN '' ELSE concat(', "publisher": "', publisher, '", "publishedDate": "', CAST(1950 + book_id % 70 AS STRING), '"') END,
    CASE WHEN language IS NULL THEN '' ELSE concat(', "language": "', language, '"') END, CASE {n} % 6 WHEN 0 THEN '' WHEN 1 THEN ', "industryIdentifiers": [{{"type": "OTHER", "identifier": "X1"}}]' WHEN 2 THEN concat(', "industryIdentifiers": [{{"type": "ISBN_13", "identifier": "', {isbn}, '"}}, {{"type": "ISBN_10", "identifier": "0306406152"}}]')
      ELSE concat(', "industryIdentifiers": [{{"type": "OTHER", "identifier": "X2"}}, {{"type": "ISBN_13", "identifier": "', {isbn}, '"}}]') END,
    CASE {n} % 7 WHEN 0 THEN '' WHEN 1 THEN ', "imageLinks": {{"smallThumbnail": "http://b/c?x=1&zoom=5&edge=curl"}}' WHEN 2 THEN ', "imageLinks": {{"thumbnail": "http://b/c?edge=curl&zoom=1&fife=w10-h20", "smallThumbnail": "http://b/s"}}' WHEN 3 THEN ', "imageLinks": {{"thumbnail": "https://b/c"}}'
      WHEN 4 THEN ', "imageLinks": {{"thumbnail": "", "smallThumbnail": "http://b/c?id=3"}}' WHEN 5 THEN ', "imageLinks": {{}}' ELSE concat(', "imageLinks": {{"thumbnail": "http://b/c?id=', CAST(book_id AS STRING), '&zoom=2"}}') END, '}}}}')"""


def _found(k: int) -> str:
    """One document of a search payload."""
    n = f"(book_id + {k})"
    return f"""concat('{{"key": "/works/OL', CAST(book_id * 10 + {k} AS STRING), 'W", "title": ', {_text_or_null('title')}, CASE {n} % 3 WHEN 0 THEN '' WHEN 1 THEN concat(', "author_name": ["', author, '"]') ELSE concat(', "author_name": ["', author, '", "Plato"]') END,
    CASE {n} % 4 WHEN 0 THEN '' WHEN 1 THEN ', "publisher": []' ELSE concat(', "publisher": ["', publisher, '", "P2"]') END, CASE {n} % 5 WHEN 0 THEN ', "isbn": []' WHEN 1 THEN '' ELSE concat(', "isbn": ["', coalesce(isbn, '0306406152'), '", "1"]') END, CASE WHEN {n} % 3 = 1 THEN ', "language": ["spa", "eng"]' ELSE '' END,
    CASE {n} % 4 WHEN 0 THEN ', "first_publish_year": 0' WHEN 1 THEN '' ELSE concat(', "first_publish_year": ', CAST(1900 + book_id % 100 AS STRING)) END, CASE {n} % 3 WHEN 0 THEN ', "cover_i": 0' WHEN 1 THEN concat(', "cover_i": ', CAST(book_id AS STRING)) ELSE '' END, '}}')"""


def _match(k: int) -> str:
    """One answer of a series provider: names and numbers under other keys, as text, or of other kinds."""
    n = f"(book_id + {k})"
    return f"""concat('{{"id": ', CAST({n} AS STRING), CASE {n} % 5 WHEN 0 THEN concat(', "name": "', observed_title, '"') WHEN 1 THEN ', "title": ""' WHEN 2 THEN '' ELSE concat(', "title": "', observed_title, '", "name": "N"') END, CASE {n} % 3 WHEN 0 THEN concat(', "series": "', series, '"') ELSE '' END,
    CASE {n} % 7 WHEN 0 THEN ', "volume": 3' WHEN 1 THEN ', "volume": "4"' WHEN 2 THEN ', "volume": 2.5' WHEN 3 THEN ', "volume": "2.5"' WHEN 4 THEN ', "volume": " 7 "' WHEN 5 THEN ', "volume": "x"' ELSE '' END,
    CASE {n} % 6 WHEN 0 THEN ', "chapter": 12.5' WHEN 1 THEN ', "chapter": 0, "number": "8"' WHEN 2 THEN ', "number": 9' WHEN 3 THEN ', "chapter": "x", "number": 1' WHEN 4 THEN ', "chapter": "3.25"' ELSE '' END, CASE {n} % 4 WHEN 0 THEN ', "series_position": 1.5' WHEN 1 THEN ', "series_position": "y"' ELSE '' END, '}}')"""


_CREDIT = "CASE book_id % 4 WHEN 0 THEN concat(author, '; Ann Lee') WHEN 1 THEN concat('Bob,', author) WHEN 2 THEN '' ELSE author END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "books": (("part",), """SELECT p_partkey + 1 AS book_id,
  CASE WHEN p_partkey % 11 = 0 THEN concat(upper(p_name), ' [retail]') WHEN p_partkey % 13 = 0 THEN concat(replace(p_name, ' ', '_'), '.epub')
    WHEN p_partkey % 17 = 0 THEN concat(p_name, ' (Special Edition)') WHEN p_partkey % 19 = 0 THEN concat('The ', p_name)
    WHEN p_partkey % 23 = 0 THEN CAST(NULL AS STRING) ELSE p_name END AS title,
  p_name AS observed_title,
  CASE p_partkey % 12 WHEN 0 THEN 'Johannes van der Waals' WHEN 1 THEN 'Mario Vargas Llosa' WHEN 2 THEN 'Tolkien, J.R.R.' WHEN 3 THEN 'The Economist'
    WHEN 4 THEN 'Unknown' WHEN 5 THEN 'Pope Francis' WHEN 6 THEN 'Plato' WHEN 7 THEN 'Ursula K. Le Guin;/' WHEN 8 THEN 'calibre' WHEN 9 THEN 'Simone de Beauvoir'
    WHEN 10 THEN 'Jane Austen & Mary Shelley' ELSE 'Van Morrison' END AS author,
  p_brand AS series, CASE WHEN p_partkey % 29 = 0 THEN p_size + 0.5E0 ELSE CAST(p_size AS DOUBLE) END AS series_index, p_type AS publisher,
  CASE p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' ELSE CAST(NULL AS STRING) END AS language,
  concat('978', lpad(CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 60 ELSE p_partkey END AS STRING), 9, '0')) AS isbn_body,
  p_partkey % 7 = 0 AS isbn_corrupt, p_partkey % 31 = 0 AS isbn_absent, CASE WHEN p_partkey % 21 <> 0 THEN '2019-05-01' END AS pubdate,
  CASE WHEN p_partkey % 10 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 9 = 0 THEN 'not a date' ELSE concat('2024-01-', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), ' 10:00:00') END AS last_modified,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(NULL AS STRING) WHEN p_partkey % 4 = 0 THEN 'Austen, Jane' ELSE 'Austen, Jane & Plato' END AS author_sort FROM part"""),
    "author_links": (("part",), """SELECT p_partkey + 1 AS book_id, p_partkey * 2 AS link_id, 'Austen, Jane' AS sort FROM part UNION ALL SELECT p_partkey + 1, p_partkey * 2 + 1, 'Plato' FROM part WHERE p_partkey % 5 <> 0"""),
    "rated": (("part",), """SELECT p_partkey + 1 AS book_id, 1 + p_partkey % 10 AS rating FROM part WHERE p_partkey % 8 <> 0"""),
    "histograms": (("lineitem",), """SELECT l_partkey + 1 AS cover_id, (l_suppkey * 37 + l_linenumber * 11) % 256 AS bin, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey + 1, (l_suppkey * 37 + l_linenumber * 11) % 256"""),
    "cover_spectra": (("part",), """SELECT p_partkey + 1 AS cover_id, (p_partkey % 70) / 10.0E0 AS her, (p_partkey % 45) / 100.0E0 AS acf, p_partkey % 6 = 0 AS folio, p_partkey % 11 = 0 AS mono, (p_partkey % 81) / 10.0E0 AS entropy,
  80 + (p_partkey * 37) % 1500 AS width, 120 + (p_partkey * 53) % 2300 AS height FROM part"""),
    "books_isbn": (("books",), """SELECT b.*, CASE WHEN isbn_absent THEN CAST(NULL AS STRING) ELSE concat(isbn_body, CAST((chk + CASE WHEN isbn_corrupt THEN 1 ELSE 0 END) % 10 AS STRING)) END AS isbn
FROM (SELECT *, (10 - (CAST(substr(isbn_body,1,1) AS INT) + 3*CAST(substr(isbn_body,2,1) AS INT) + CAST(substr(isbn_body,3,1) AS INT) + 3*CAST(substr(isbn_body,4,1) AS INT)
  + CAST(substr(isbn_body,5,1) AS INT) + 3*CAST(substr(isbn_body,6,1) AS INT) + CAST(substr(isbn_body,7,1) AS INT) + 3*CAST(substr(isbn_body,8,1) AS INT)
  + CAST(substr(isbn_body,9,1) AS INT) + 3*CAST(substr(isbn_body,10,1) AS INT) + CAST(substr(isbn_body,11,1) AS INT) + 3*CAST(substr(isbn_body,12,1) AS INT)) % 10) % 10 AS chk FROM books) b"""),
    "formats": (("lineitem",), """SELECT DISTINCT l_partkey + 1 AS book_id, CASE l_linenumber % 4 WHEN 0 THEN 'EPUB' WHEN 1 THEN 'PDF' WHEN 2 THEN 'MOBI' ELSE 'AZW3' END AS format,
  concat(md5(concat(CAST(l_partkey % 30 AS STRING), '-', CAST(l_linenumber % 4 AS STRING))), md5(concat(CAST(l_partkey % 30 AS STRING), '-', CAST(l_linenumber % 4 AS STRING)))) AS digest
FROM lineitem WHERE l_quantity < 10"""),
    "candidates": (("books_isbn",), """SELECT b.book_id, v.pos, v.provider, CASE WHEN (b.book_id + v.pos) % 9 = 0 THEN 'atomic habits' ELSE b.observed_title END AS title,
  CASE WHEN (b.book_id + v.pos) % 9 = 0 THEN 'James Clear' WHEN v.pos = 1 THEN lower(b.author) ELSE b.author END AS author,
  CASE WHEN (b.book_id + v.pos) % 10 = 0 THEN '9780306406157' ELSE b.isbn END AS isbn13, v.pos = 1 AS is_hd_cover, CASE WHEN (b.book_id + v.pos) % 4 = 0 THEN 'https://books.example/cover' END AS cover_url
FROM books_isbn b CROSS JOIN (SELECT 0 AS pos, 'openlibrary' AS provider UNION ALL SELECT 1, 'google_books' UNION ALL SELECT 2, 'calibre_fetch') v"""),
    "operations": (("orders",), """SELECT o_orderkey AS operation_id, o_custkey AS book_key, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'verifying' WHEN o_orderkey % 2 = 0 THEN 'requested' ELSE 'claimed' END AS state,
  CASE WHEN o_orderkey % 4 = 0 THEN 'v1' ELSE 'manifestation-v2' END AS policy_version, concat('pilot-', CAST(o_custkey % 5 AS STRING)) AS pilot_id,
  concat('apply:', CAST(o_custkey AS STRING), ':', o_orderpriority) AS idempotency_key FROM orders"""),
    "requests": (("events",), """SELECT event_id, ts, user_id AS identity, event_type AS route, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
  value / 100.0E0 AS duration_s FROM events"""),
    "library_books": (("books",), """SELECT book_id, CASE WHEN book_id % 71 = 0 THEN '' ELSE title END AS title, author_sort, pubdate, last_modified AS published_date, series_index, concat('A/', CAST(book_id AS STRING)) AS path, book_id % 3 = 0 AS has_cover,
  CASE WHEN book_id % 4 = 0 THEN 'Second edition' END AS edition FROM books"""),
    "library_authors": (("books",), """SELECT book_id, book_id * 10 AS link_id, ' Zadie Smith ' AS name FROM books WHERE book_id % 3 = 0 UNION ALL SELECT book_id, book_id * 10 + 1, author FROM books UNION ALL SELECT book_id, book_id * 10 + 2, ' ' FROM books WHERE book_id % 5 = 0"""),
    "library_publishers": (("books",), """SELECT book_id, book_id AS link_id, publisher AS name FROM books WHERE book_id % 4 <> 0 UNION ALL SELECT book_id, book_id + 1, 'Second House' FROM books WHERE book_id % 97 = 0"""),
    "library_series": (("books",), """SELECT book_id, book_id AS link_id, series AS name FROM books WHERE book_id % 5 <> 0 UNION ALL SELECT book_id, book_id + 1, 'Second series' FROM books WHERE book_id % 89 = 0"""),
    "library_languages": (("books",), """SELECT book_id, 2 AS item_order, book_id AS link_id, 'ENG' AS name FROM books WHERE book_id % 2 = 0 UNION ALL SELECT book_id, 1, book_id + 1, ' Spa' FROM books WHERE book_id % 6 = 0 UNION ALL SELECT book_id, 2, book_id + 2, 'deu' FROM books WHERE book_id % 10 = 0"""),
    "library_tags": (("books",), """SELECT book_id, 9 - book_id % 3 AS link_id, series AS name FROM books WHERE book_id % 3 <> 0 UNION ALL SELECT book_id, CASE WHEN book_id % 4 = 0 THEN 5 ELSE 10 END, 'Fiction' FROM books WHERE book_id % 2 = 0"""),
    "library_comments": (("books",), """SELECT book_id, 1 AS link_id, concat('On ', observed_title) AS name FROM books WHERE book_id % 8 = 0 UNION ALL SELECT book_id, 2, 'More' FROM books WHERE book_id % 83 = 0 UNION ALL SELECT book_id, 3, 'Other' FROM books WHERE book_id % 83 = 0"""),
    "library_formats": (("formats",), """SELECT book_id, format, CASE WHEN book_id % 73 = 0 AND format = 'PDF' THEN 'sub/file' ELSE concat('file', CAST(book_id AS STRING)) END AS name FROM formats UNION ALL SELECT book_id, lower(format), 'again' FROM formats WHERE book_id % 79 = 0 AND format = 'EPUB'"""),
    "volume_payloads": (("books_isbn",), f"""SELECT book_id, CASE WHEN book_id % 31 = 0 THEN '{{"items": [{{"id": "cut' WHEN book_id % 29 = 0 THEN '{{"totalItems": 0}}' ELSE concat('{{"items": [', {_volume(0)}, CASE WHEN book_id % 3 > 0 THEN concat(', ', {_volume(1)}) ELSE '' END, ']}}') END AS payload FROM books_isbn"""),
    "search_payloads": (("books_isbn",), f"""SELECT book_id, CASE WHEN book_id % 31 = 0 THEN 'no json' WHEN book_id % 29 = 0 THEN '{{}}' ELSE concat('{{"docs": [', {', '.join(f"{_found(k)}, ', '" for k in range(5))}, {_found(5)}, ']}}') END AS payload FROM books_isbn"""),
    "record_payloads": (("books_isbn",), """SELECT book_id, isbn, CASE WHEN book_id % 31 = 0 THEN '{"ISBN:' WHEN book_id % 29 = 0 THEN '{"ISBN:0": {"title": "other"}}' ELSE concat('{"ISBN:', isbn, '": {"url": "https://o/', CAST(book_id AS STRING), '"', CASE WHEN title IS NULL THEN '' ELSE concat(', "title": "', title, '"') END,
  CASE book_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(', "authors": [{"name": "', author, '"}, {"url": "u"}]') ELSE concat(', "authors": [{"name": "', author, '"}, {"name": "Plato"}]') END, CASE book_id % 4 WHEN 0 THEN ', "publishers": []' ELSE concat(', "publishers": [{"name": "', publisher, '"}, {"name": "P2"}]') END,
  CASE WHEN book_id % 5 < 2 THEN ', "languages": [{"key": "/languages/SPA"}, {"key": "/languages/eng"}]' ELSE '' END, CASE WHEN book_id % 6 = 0 THEN '' ELSE concat(', "publish_date": "', CAST(1950 + book_id % 60 AS STRING), '"') END, CASE WHEN book_id % 7 < 3 THEN concat(', "cover": {"large": "https://c/', CAST(book_id AS STRING), '"}') ELSE ', "cover": {"small": "s"}' END, '}}') END AS payload FROM books_isbn"""),
    "match_payloads": (("books",), f"""SELECT book_id, CASE book_id % 5 WHEN 0 THEN {_match(0)} WHEN 1 THEN concat('[', {_match(0)}, ', "text", ', {_match(1)}, ', ', {_match(2)}, ']') WHEN 2 THEN concat('{{"candidates": [', {_match(0)}, ', ', {_match(3)}, ', ', {_match(4)}, ', ', {_match(5)}, ']}}') WHEN 3 THEN concat(' [ ', {_match(2)}, ']') ELSE CASE book_id % 3 WHEN 0 THEN '{{"candidates": {{}}}}' WHEN 1 THEN '[{{' ELSE '"text"' END END AS payload FROM books"""),
    "sidecars": (("books_isbn",), f"""SELECT book_id, concat('<ComicInfo>', CASE WHEN title IS NULL THEN '' ELSE concat('<Title> ', replace(title, '&', '&amp;'), '</Title>') END, '<Series>', series, '</Series>', CASE book_id % 7 WHEN 0 THEN '<Number>n/a</Number>' WHEN 1 THEN '' ELSE concat('<Number> ', CAST(book_id % 40 AS STRING), '.5</Number>') END,
  CASE book_id % 3 WHEN 0 THEN '<Volume>2</Volume>' WHEN 1 THEN '<Volume>two</Volume>' ELSE '' END, CASE WHEN book_id % 4 = 0 THEN '<Chapter>7</Chapter>' ELSE '' END, '<Writer>', replace({_CREDIT}, '&', '&amp;'), '</Writer>', CASE WHEN book_id % 5 = 0 THEN '' ELSE concat('<Publisher>', publisher, '</Publisher>') END,
  CASE book_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<Year>2019</Year>' ELSE concat('<Year>', CAST(1950 + book_id % 70 AS STRING), '</Year><Month> ', CAST(1 + book_id % 12 AS STRING), '</Month>') END, CASE WHEN language IS NULL THEN '' ELSE concat('<LanguageISO> ', upper(language), '</LanguageISO>') END,
  CASE book_id % 3 WHEN 0 THEN concat('<GTIN>', coalesce(isbn, ''), '</GTIN>') WHEN 1 THEN '<GTIN>nonsense</GTIN><ISBN>0306406152</ISBN>' ELSE '' END, CASE book_id % 3 WHEN 0 THEN '<Genre>a, ,b</Genre>' WHEN 1 THEN concat('<Genre>', series, '</Genre>') ELSE '' END, '</ComicInfo>') AS xml FROM books_isbn"""),
    "opf_bodies": (("books_isbn",), """SELECT book_id, concat('log line ', CASE WHEN book_id % 11 = 0 THEN 'no record' ELSE concat('<?xml version="1.0"?><package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><dc:title>', observed_title, '</dc:title><dc:creator>', replace(author, '&', 'and'), '</dc:creator>',
  CASE WHEN book_id % 3 = 0 THEN '<dc:creator>Bob</dc:creator>' ELSE '' END, CASE WHEN book_id % 4 = 0 THEN '' ELSE concat('<dc:publisher>', publisher, '</dc:publisher>') END, '<dc:date>', CAST(1950 + book_id % 70 AS STRING), '-05-01T00:00:00</dc:date>', CASE WHEN language IS NULL THEN '' ELSE concat('<dc:language>', language, '</dc:language>') END,
  '<dc:identifier opf:scheme="UUID">u', CAST(book_id AS STRING), '</dc:identifier>', CASE WHEN isbn IS NULL THEN '' ELSE concat('<dc:identifier opf:scheme="', CASE WHEN book_id % 2 = 0 THEN 'ISBN' ELSE 'isbn' END, '">', isbn, '</dc:identifier>') END, '</metadata></package>') END,
  CASE WHEN book_id % 5 = 0 THEN concat('<?xml version="1.0"?><package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', series, '</dc:title><dc:creator>Eve</dc:creator></metadata></package>') ELSE '' END) AS body FROM books_isbn"""),
    "addresses": (("candidates",), """SELECT book_id, pos, isbn13, book_id * 7 % 50 AS cover_id, CASE WHEN book_id % 8 = 7 THEN NULL WHEN book_id % 8 = 6 THEN '' ELSE concat(CASE WHEN book_id % 3 = 0 THEN 'http' ELSE 'https' END, '://books.google.com/books', CASE book_id % 5 WHEN 0 THEN '' WHEN 1 THEN '?edge=curl&id=' WHEN 2 THEN '?id=' WHEN 3 THEN '?zoom=1&edge=curl&id=' ELSE '?zoom=5&fife=w10-h20&id=' END, CAST(book_id AS STRING)) END AS thumbnail,
  CASE WHEN book_id % 3 = 0 THEN concat('vol', CAST(book_id AS STRING)) END AS volume, concat(CASE book_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'HTTPS' ELSE 'https' END, '://', CASE WHEN book_id % 7 = 0 THEN 'me:x@' ELSE '' END, CASE pos WHEN 0 THEN 'openlibrary.org' WHEN 1 THEN 'evil.example' ELSE 'Covers.OpenLibrary.org' END, CASE book_id % 4 WHEN 0 THEN ':443' WHEN 1 THEN ':8443' ELSE '' END, '/b?x=:1') AS address FROM candidates"""),
    "tokens": (("formats",), """SELECT book_id, format, concat(CAST(book_id AS STRING), CASE book_id % 5 WHEN 0 THEN '.w e' WHEN 1 THEN '.tar.' WHEN 2 THEN '' ELSE '.' END, lower(format), CASE WHEN book_id % 7 = 0 THEN 'abcdefghijklmnop' ELSE '' END) AS made,
  concat(CASE WHEN book_id % 4 = 0 THEN 'OEBPS/COPYRIGHT-' WHEN book_id % 9 = 0 THEN 'Colophon/' ELSE 'OEBPS/' END, lower(format), CASE WHEN book_id % 3 = 0 THEN '-Title' ELSE '-x' END, '.xhtml') AS path, book_id % 4 AS place,
  concat('see ISBN-13: ', CAST(book_id AS STRING), CASE WHEN book_id % 6 = 0 THEN ' or ISBN 0-306-40615-2 and' ELSE ' or' END, CASE WHEN book_id % 8 = 0 THEN ' none.' ELSE ' ISBN 978-0-306-40615-7.' END) AS says FROM formats"""),
    "book_states": (("orders",), """SELECT o_orderkey AS result_id, o_custkey AS book_key, CASE o_orderkey % 14 WHEN 0 THEN 'pending' WHEN 1 THEN 'snapshotting' WHEN 2 THEN 'extracting' WHEN 3 THEN 'resolving' WHEN 4 THEN 'decided' WHEN 5 THEN 'applying' WHEN 6 THEN 'shadowed' WHEN 7 THEN 'verified' WHEN 8 THEN 'review' WHEN 9 THEN 'deferred' WHEN 10 THEN 'failed' WHEN 11 THEN 'source_changed' WHEN 12 THEN 'blocked_recovery' ELSE 'odd' END AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('ev_', CAST(o_orderkey AS STRING)) END AS evidence_id FROM orders"""),
    "outbox": (("orders",), """SELECT o_orderkey AS event_id, o_orderkey AS aggregate_id, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'failed' ELSE 'published' END AS status FROM orders"""),
    "changes": (("orders",), """SELECT o_orderkey AS change_id, CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'rolled_back' ELSE 'proposed' END AS status FROM orders WHERE o_orderkey % 3 = 0"""),
    "pilots": (("customer",), """SELECT DISTINCT concat('pilot-', CAST(c_custkey % 5 AS STRING)) AS pilot_id, CASE c_custkey % 5 WHEN 1 THEN 'open' WHEN 2 THEN 'completed' ELSE 'stopped' END AS state, 10 + c_custkey % 5 AS reserved, 40 + c_custkey % 5 AS maximum FROM customer"""),
    "ledger_operations": (("operations",), """SELECT *, CASE WHEN operation_id % 6 <> 0 THEN created_at END AS completed_at FROM operations"""),
    "acknowledgements": (("orders",), """SELECT o_orderkey AS operation_id FROM orders WHERE o_orderkey % 7 < 4"""),
    "write_locks": (("customer",), """SELECT c_custkey AS book_key FROM customer WHERE c_custkey % 11 = 0"""),
    "all_runs": (("runs",), """SELECT run_id, CASE WHEN run_id % 10 = 3 THEN 'inventorying' WHEN run_id % 10 = 7 THEN 'odd' ELSE status END AS status, started_at, heartbeat_at, CASE WHEN run_id % 9 = 0 THEN 'other' ELSE 'certificate-a-v1' END AS contract_version, CASE WHEN run_id % 8 = 0 THEN 'v1' ELSE 'manifestation-v2' END AS pipeline_version FROM runs"""),
    "run_books": (("orders",), """SELECT o_orderkey AS book_key, concat('run-', CAST(o_custkey % 13 AS STRING)) AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'no_change' WHEN 1 THEN 'suggest_fix' WHEN 2 THEN 'needs_review' ELSE 'defer' END AS status FROM orders"""),
    "run_starts": (("orders",), """SELECT concat('run-', CAST(o_custkey % 13 AS STRING)) AS run_id, max(o_orderdate) AS created_at FROM orders GROUP BY concat('run-', CAST(o_custkey % 13 AS STRING))"""),
    "message_parts": (("documents",), """SELECT doc_id AS message_id, 0 AS seq, 'text' AS kind, source AS content FROM documents UNION ALL SELECT doc_id, 1, 'image', concat('sha:', CAST(doc_id AS STRING)) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'text', lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3, 'image', 'sha:x' FROM documents WHERE doc_id % 6 = 0"""),
    "heartbeats": (("events",), """SELECT concat('w-', CAST(user_id % 7 AS STRING)) AS worker, ts FROM events"""),
    "calibration": (("labels", "documents"), """SELECT d.doc_id AS evidence_id, CASE d.doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier, d.doc_id % 2 = 0 AS would_auto_apply,
  l.quality = 1 AS identity_correct, l.toxic = 0 AS patch_correct, CASE WHEN d.doc_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE d.n_chars / 100.0E0 END AS review_seconds, d.n_chars AS egress_bytes
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
UNION ALL SELECT l.doc_id, 'B', TRUE, TRUE, TRUE, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT) FROM labels l WHERE l.doc_id % 17 = 0"""),
    "snippets": (("books_isbn",), """SELECT book_id, 0 AS seq, 'title_page' AS source, concat(observed_title, ' by ', author) AS text FROM books_isbn
UNION ALL SELECT book_id, 1, 'copyright_page', concat('Copyright 2019. ISBN: ', coalesce(isbn, 'none'), ' (epub). Published by ', publisher, '.') FROM books_isbn"""),
    "evidence": (("books_isbn",), """SELECT * FROM (SELECT b.book_id, r.root AS independence_root, r.kind AS source_kind, f.field, b.isbn AS manifestation_isbn, r.kind <> 'vision' AS authoritative,
    CASE f.field WHEN 'identifiers' THEN b.isbn WHEN 'title' THEN CASE WHEN r.root = 'google_books' AND b.book_id % 8 = 0 THEN 'other title' ELSE b.observed_title END WHEN 'authors' THEN b.author ELSE b.language END AS value
  FROM books_isbn b CROSS JOIN (SELECT 'book_content' AS root, 'content_native' AS kind UNION ALL SELECT 'openlibrary', 'provider_structured' UNION ALL SELECT 'google_books', 'provider_structured' UNION ALL SELECT 'vision', 'vision') r
  CROSS JOIN (SELECT 'identifiers' AS field UNION ALL SELECT 'title' UNION ALL SELECT 'authors' UNION ALL SELECT 'languages') f
  WHERE NOT (r.root = 'openlibrary' AND b.book_id % 6 = 0)) e WHERE value IS NOT NULL"""),
    "cover_stats": (("part",), """SELECT p_partkey + 1 AS cover_id, 80 + (p_partkey * 37) % 1500 AS width, 120 + (p_partkey * 53) % 2300 AS height, 2000 + (p_partkey * 9973) % 16000000 AS size_bytes,
  (p_partkey % 240) / 10.0E0 AS avg_grad, CAST(5 + p_partkey % 80 AS DOUBLE) AS std_dev, (p_partkey % 81) / 10.0E0 AS entropy, (p_partkey % 101) / 100.0E0 AS dominant_ratio,
  ((p_partkey * 7) % 101) / 100.0E0 AS white_ratio, ((p_partkey * 3) % 31) / 100.0E0 AS dark_ratio,
  CASE p_partkey % 9 WHEN 0 THEN 'z-library' WHEN 1 THEN 'New York Times Bestseller' WHEN 2 THEN 'Chapter 1 contents' ELSE '' END AS ocr_text,
  CAST((p_partkey % 40) * 72057594037927 + CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 1048583 ELSE 0 END AS BIGINT) AS phash FROM part"""),
    "imprints": (("books_isbn",), """SELECT book_id, 0 AS seq, 'title_page' AS source, CASE book_id % 4 WHEN 0 THEN concat(chr(10), ' ', coalesce(title, 'Untitled'), ' by ', author) WHEN 1 THEN concat(coalesce(title, 'Untitled'), chr(10), 'Translated by Someone', chr(10), author)
    WHEN 2 THEN coalesce(title, 'Untitled') ELSE concat(coalesce(title, 'Untitled'), chr(10), ' ', chr(10), author, chr(10), 'ISBN 1') END AS text FROM books_isbn
UNION ALL SELECT book_id, 1, 'copyright_page', concat(CASE WHEN book_id % 13 = 0 THEN 'Notes of ' ELSE 'Copyright © ' END, CAST(1950 + book_id % 85 AS STRING), '. ISBN', CASE book_id % 3 WHEN 0 THEN '-13: ' WHEN 1 THEN ' ' ELSE ': ' END, CASE WHEN isbn IS NULL THEN 'none' ELSE concat(substr(isbn, 1, 3), '-', substr(isbn, 4)) END,
    ' (', CASE book_id % 4 WHEN 0 THEN 'ePub' WHEN 1 THEN 'Paper' WHEN 2 THEN 'E-Book' ELSE ' digital edition' END, '). ', CASE book_id % 5 WHEN 0 THEN 'PUBLISHED BY ' WHEN 1 THEN 'Publicado por ' WHEN 2 THEN 'Editorial ' WHEN 3 THEN 'ediciones ' ELSE 'From ' END,
    CASE WHEN book_id % 17 = 0 THEN 'Autor' ELSE publisher END, ' & Co., ', CAST(1700 + book_id % 400 AS STRING), '.', CASE WHEN book_id % 3 = 0 THEN '' ELSE concat(' ', CASE book_id % 5 WHEN 0 THEN 'D.L.: ' WHEN 1 THEN 'DEPÓSITO LEGAL: ' WHEN 2 THEN 'Depósito legal ' WHEN 3 THEN 'D. L. ' ELSE 'deposito legal: ' END,
      CASE book_id % 4 WHEN 0 THEN 'M-' WHEN 1 THEN 'B. ' WHEN 2 THEN '' ELSE 'SE-' END, CAST(book_id % 900000 AS STRING), CASE book_id % 6 WHEN 0 THEN '-2017' WHEN 1 THEN '/18' WHEN 2 THEN ' - 1999' WHEN 4 THEN '-62' ELSE '/ 07' END, '.') END) FROM books_isbn
UNION ALL SELECT book_id, 2, 'body', CASE WHEN book_id % 10 = 0 THEN 'Talleres de Sol, 1987. ISBN 978-0-306-40615-7 (paper)' WHEN book_id % 7 = 0 THEN 'All rights reserved. Se terminó de imprimir en 2001. D.L.: M-55-2003' WHEN book_id % 11 = 0 THEN concat('Long page', repeat(' word', 120)) ELSE 'Once upon a time' END FROM books_isbn
UNION ALL SELECT book_id, 3, 'body', CASE WHEN book_id % 9 = 0 THEN 'ACHEVÉ D''IMPRIMER en 2004' WHEN book_id % 4 = 0 THEN 'SE TERMINÓ DE IMPRIMIR en los talleres gráficos de Luz. Published by Third House.' ELSE 'The end' END FROM books_isbn"""),
    "identifiers": (("books_isbn",), """SELECT book_id, 'ISBN' AS type, isbn AS value FROM books_isbn WHERE isbn IS NOT NULL UNION ALL SELECT book_id, 'isbn', '9780306406157' FROM books_isbn WHERE book_id % 25 = 0 UNION ALL SELECT book_id, 'Goodreads', CAST(book_id * 7 AS STRING) FROM books_isbn"""),
    "format_evidence": (("formats", "books_isbn"), """SELECT f.book_id, f.format, f.digest, CASE WHEN f.book_id % 37 = 0 AND f.format = 'MOBI' THEN 'protected' ELSE 'readable' END AS status,
  CASE WHEN f.book_id % 41 = 0 AND f.format = 'PDF' THEN '9780306406157' ELSE b.isbn END AS isbn, CASE WHEN f.book_id % 43 = 0 AND f.format = 'PDF' THEN 'Variant title' ELSE b.observed_title END AS title,
  b.author AS authors, b.language AS languages FROM formats f JOIN books_isbn b ON b.book_id = f.book_id"""),
    "current_fields": (("books_isbn",), """SELECT book_id, 'title' AS field, title AS value FROM books_isbn UNION ALL SELECT book_id, 'authors', author FROM books_isbn
UNION ALL SELECT book_id, 'languages', language FROM books_isbn UNION ALL SELECT book_id, 'identifiers', isbn FROM books_isbn"""),
    "pairs": (("books_isbn",), """SELECT book_id,
  CASE WHEN book_id % 37 = 0 THEN concat(observed_title, ' by Jane Austen') WHEN book_id % 41 = 0 THEN concat(observed_title, '!') WHEN book_id % 43 = 0 THEN 'zzz'
    WHEN book_id % 47 = 0 THEN concat(observed_title, ' and more tales of the old northern road') ELSE title END AS d_title,
  CASE WHEN book_id % 53 = 0 THEN CAST(NULL AS STRING) WHEN book_id % 59 = 0 THEN '' WHEN book_id % 61 = 0 THEN concat(observed_title, 's') ELSE observed_title END AS o_title,
  CASE WHEN book_id % 15 = 2 THEN 'Mikhail Bulgakov' WHEN book_id % 15 = 3 THEN 'Jane Austen & Plato' WHEN book_id % 15 = 4 THEN CAST(NULL AS STRING) ELSE author END AS d_authors,
  CASE book_id % 14 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Tolkien' WHEN 2 THEN 'Михаил Булгаков' WHEN 3 THEN 'Jane Austen' WHEN 4 THEN 'Plato & Mary Shelley' WHEN 5 THEN upper(author) WHEN 6 THEN 'J.R.R. Tolkien' ELSE author END AS o_authors,
  CASE WHEN book_id % 16 = 0 THEN ten ELSE isbn END AS d_isbn,
  CASE WHEN book_id % 4 = 1 THEN concat(isbn_body, '0') WHEN book_id % 18 = 0 THEN ten WHEN book_id % 23 = 0 THEN CAST(NULL AS STRING) ELSE isbn END AS o_isbn,
  CASE WHEN book_id % 6 = 0 THEN CAST(NULL AS STRING) ELSE publisher END AS d_publisher,
  CASE WHEN book_id % 7 = 0 THEN CAST(NULL AS STRING) WHEN book_id % 5 = 0 THEN concat(publisher, ' Books') WHEN book_id % 11 = 0 THEN 'QQ' ELSE upper(publisher) END AS o_publisher,
  CASE WHEN book_id % 9 = 0 THEN CAST(NULL AS STRING) WHEN book_id % 10 = 0 THEN 'undated' ELSE '2019-05-01' END AS d_date,
  CASE book_id % 8 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '2019' WHEN 2 THEN '2020-01-01' WHEN 3 THEN '1990' ELSE '2019-05' END AS o_date,
  language AS d_language, CASE WHEN book_id % 6 = 0 THEN 'it' WHEN book_id % 7 = 0 THEN CAST(NULL AS STRING) ELSE upper(language) END AS o_language,
  CASE WHEN book_id % 13 = 0 THEN CAST(NULL AS STRING) ELSE series END AS d_series, CASE WHEN book_id % 10 = 0 THEN CAST(NULL AS STRING) WHEN book_id % 21 = 0 THEN 'Other series' ELSE lower(series) END AS o_series,
  series_index AS d_series_index, CASE WHEN book_id % 12 = 0 THEN CAST(NULL AS DOUBLE) ELSE floor(series_index) END AS o_series_index,
  CASE WHEN book_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(book_id % 4 AS DOUBLE) END AS d_volume, CASE WHEN book_id % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE (book_id % 8) / 2.0E0 END AS o_volume,
  CASE WHEN book_id % 5 < 2 THEN CAST(NULL AS DOUBLE) ELSE 12.5E0 END AS d_chapter, CASE WHEN book_id % 7 < 2 THEN CAST(NULL AS DOUBLE) ELSE 12.5E0 + (book_id % 3) END AS o_chapter,
  CASE WHEN book_id % 11 < 6 THEN CAST(NULL AS DOUBLE) ELSE 1.0E0 END AS d_series_position, CASE WHEN book_id % 6 < 3 THEN CAST(NULL AS DOUBLE) ELSE 1.0E0 + (book_id % 2) END AS o_series_position,
  book_id % 3 = 0 AS sampled, book_id % 29 = 0 AS low
FROM (SELECT *, concat(substr(isbn_body, 4, 9), CASE WHEN rest = 0 THEN '0' WHEN rest = 1 THEN 'X' ELSE CAST(11 - rest AS STRING) END) AS ten FROM (SELECT *, (
    10*CAST(substr(isbn_body,4,1) AS INT) + 9*CAST(substr(isbn_body,5,1) AS INT) + 8*CAST(substr(isbn_body,6,1) AS INT) + 7*CAST(substr(isbn_body,7,1) AS INT) + 6*CAST(substr(isbn_body,8,1) AS INT)
  + 5*CAST(substr(isbn_body,9,1) AS INT) + 4*CAST(substr(isbn_body,10,1) AS INT) + 3*CAST(substr(isbn_body,11,1) AS INT) + 2*CAST(substr(isbn_body,12,1) AS INT)) % 11 AS rest FROM books_isbn) x) y"""),
    "runs": (("orders",), """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'running' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '90' SECOND END AS heartbeat_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '600' SECOND END AS finished_at,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('w-', CAST(o_custkey % 4 AS STRING)) END AS lease_owner, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '120' SECOND END AS lease_expires_at FROM orders"""),
}


def _needs(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in seen:
            _needs(VIEWS[n][0], seen)
            seen.append(n)
    return seen


def sql(body: str, *names: str, tables: str = "") -> str:
    """`body` with the named views in front of it."""
    parts = ([tables] if tables else []) + [f"{n} AS ({VIEWS[n][1]})" for n in _needs(names, [])]
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, body[len('WITH RECURSIVE ') :]])}"
    if body.startswith("WITH "):
        parts, body = [*parts, body[len("WITH ") :]], ""
    return f"WITH {', '.join(parts)} {body}" if parts else body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, over the Parquet files of a folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = sorted({t for n in _needs((name,), []) for t in VIEWS[n][0] if t not in VIEWS})
    tables = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in base)
    return spark.sql(sql(f"SELECT * FROM {name}", name, tables=tables))
