"""Field rules against one-row readings of the ladders with difflib, and cases made by hand."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import consensus, verify
from shelfmark.sources.catalogue import view

SF = "/root/testdata/sf0.001"
NAMES = ("title", "authors", "isbn", "publisher", "date", "language", "series", "series_index", "volume", "chapter", "series_position")
NUMBERS = NAMES[7:]


def pairs(spark, rows):
    """Rows of declared and observed values by field; the others are null."""
    kind = ", ".join(f"{s}_{n} {'double' if n in NUMBERS else 'string'}" for n in NAMES for s in "do")
    made = [(i, *[r.get(f"{s}_{n}") for n in NAMES for s in "do"], r.get("sampled", True), r.get("low", False)) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"book_id long, {kind}, sampled boolean, low boolean")


def told(spark, field, rows):
    got = verify.rows(verify.all_verdicts(pairs(spark, rows)), verify.FIELDS).where(F.col("field") == field).orderBy("book_id").collect()
    return [(r["verdict"], r["confidence"], r["flag"]) for r in got]


def test_titles(spark):
    cases = [
        (None, None, ("ambiguous", 0, "")), (None, "Dune", ("missing", 95, "")), (None, "It", ("missing", 70, "")), ("Dune", None, ("ambiguous", 50, "")), ("!!!", "Dune", ("ambiguous", 40, "")),
        ("Dune [retail]", "Dune", ("mismatch", 95, "")), ("Dune!!", "Dune", ("mismatch", 80, "")), ("Dune by Frank Herbert", "Dune", ("mismatch", 88, "")), ("Foundation (Special Edition)", "Foundation", ("mismatch", 82, "")),
        ("lord_of_rings_final", "The Lord of the Rings", ("mismatch", 92, "")), ("Crónica", "cronica", ("confirmed", 95, "")), ("Dune Messiah", "Dune", ("confirmed", 85, "")),
        ("Dune and what came after it in the desert", "Dune", ("mismatch", 80, "")), ("Pride and Prejudice", "War", ("mismatch", 95, "wrong_book")), ("The Hobbit Tales", "The Hobbit Stories", ("ambiguous", 60, "")),
    ]
    assert told(spark, "title", [{"d_title": d, "o_title": o} for d, o, _ in cases]) == [w for *_, w in cases]
    assert told(spark, "title", [{"d_title": "Dune", "o_title": "Dune", "low": True}, {"o_title": "Dune", "low": True}]) == [("ambiguous", 55, "")] * 2


def test_authors(spark):
    cases = [
        (None, None, ("ambiguous", 0, "")), (None, "Ann", ("missing", 95, "")), ("Ann", None, ("ambiguous", 50, "")), ("Tolkien, J.R.R.", "J.R.R. Tolkien", ("confirmed", 99, "")), ("Bob & Ann", "Ann & Bob", ("confirmed", 99, "")),
        ("Mikhail Bulgakov", "Михаил Булгаков", ("confirmed", 88, "")), ("Tolkien", "J.R.R. Tolkien", ("confirmed", 88, "")), ("Unknown", "Jane Austen", ("mismatch", 92, "")), ("Jane Austen", "Plato", ("mismatch", 92, "author_swap")),
        ("Jane Austen & Plato", "Jane Austen", ("mismatch", 88, "author_swap")), ("Jane Austen", "Jane Austen & Plato", ("mismatch", 92, "")), ("Jane Austen & Plato", "Jane Austen & Homer", ("mismatch", 80, "")),
    ]
    assert told(spark, "authors", [{"d_authors": d, "o_authors": o} for d, o, _ in cases]) == [w for *_, w in cases]


def test_publishers(spark):
    cases = [
        (None, None, ("ambiguous", 0, "")), (None, "Penguin", ("missing", 80, "")), ("Penguin", None, ("ambiguous", 50, "")), ("PENGUIN", "Penguin", ("confirmed", 99, "")), ("Penguin", "Penguin Books", ("confirmed", 85, "")),
        ("Penguin", "Orbit", ("mismatch", 85, "publisher_mismatch")), ("Harper Collins", "Harper Torch", ("ambiguous", 60, "")),
    ]
    assert told(spark, "publisher", [{"d_publisher": d, "o_publisher": o} for d, o, _ in cases]) == [w for *_, w in cases]


def test_titles_and_publishers_by_brute_force(spark):
    """Every row of the view, with normals by unicodedata and ratios by difflib, over the rungs that the view reaches."""
    p = view(spark, SF, "pairs")
    got = {(r["book_id"], r["field"]): (r["verdict"], r["confidence"]) for r in verify.rows(verify.all_verdicts(p), verify.FIELDS).where("field = 'publisher'").collect()}

    def key(x):
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(text.EDITION_TAG, "", x, flags=re.I))).strip().lower()

    for r in p.collect():
        d, o = r["d_publisher"], r["o_publisher"]
        if d is None and o is None:
            want = ("ambiguous", 0)
        elif d is None:
            want = ("missing", 80)
        elif o is None:
            want = ("ambiguous", 50)
        else:
            a, b = key(d), key(o)
            q = SequenceMatcher(None, a, b).ratio()
            want = ("confirmed", 99) if a == b else ("confirmed", 85) if q >= 0.6 and (a in b or b in a) else ("mismatch", 85) if q < 0.5 else ("ambiguous", 60)
        assert got[r["book_id"], "publisher"] == want


@pytest.mark.parametrize(("a", "b"), [("", ""), ("x", ""), ("gone girl", "girl gone"), ("a b c", "c d"), ("abc", "abd")])
def test_similarity(spark, a, b):
    def ratio(x, y):
        if not x or not y:
            return float(x == y)
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return 1 - row[-1] / max(len(x), len(y))

    s, t = set(a.split()), set(b.split())
    i, p, q = (" ".join(sorted(z)) for z in (s & t, s - t, t - s))
    one, two = f"{i} {p}".strip(), f"{i} {q}".strip()
    want = max([ratio(a, b)] + ([] if not s or not t else [ratio(i, one) if i else 0, ratio(i, two) if i else 0, ratio(one, two)]))
    got = consensus.with_similarity(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", "r").first()["r"]
    assert abs(got - want) < 1e-12


def test_unknown_author_scores_as_a_name(spark):
    books = spark.createDataFrame([(1, "gone girl", "Unknown", None)], "book_id long, title string, author string, isbn string")
    c = spark.createDataFrame([(1, 0, "p", "gone girl", "Gillian Flynn", None, False, None)], "book_id long, pos int, provider string, title string, author string, isbn13 string, is_hd_cover boolean, cover_url string")
    r = consensus.scored(books, c).first()
    assert not r["tripped"] and r["score"] < 0.5


def test_normalisers(spark):
    def one(f, x):
        return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]

    assert one(text.author_sort, "Gabriel García Márquez") == "García Márquez, Gabriel"
    assert one(text.split_authors, "Ana; Bob and Cy et al. & unknown") == ["Ana", "Bob", "Cy"]
    assert one(text.quality, "\u200b\u202e" * 40 + " some more words stand here") == "low" and one(text.quality, "five words stand here now") == "high"
    assert one(text.promoted_title, "THE ART OF AI [retail] (epub)") == "The Art of AI"
    assert one(text.verify_key, "Œuvre ﬁnale (2nd Edition)") == "œuvre finale" and one(text.plain_key, "Ǆ №5") == "dz no5"
    assert one(text.identity_key, "Straße, ＡＢＣ!") == "strasse abc"


def _plain_authors(d, o, low):
    """The ladder of V3 over one pair, with a set for each form."""
    def names(x):
        return [a.strip() for a in (x or "").split("&") if a.strip()]

    def norm(x):
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(text.EDITION_TAG, "", x, flags=re.I))).strip().lower()

    def latin(x):
        for a, b in {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}.items():
            x = x.replace(a, b)
        return x.translate(str.maketrans("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye", "ъь"))

    def display(x):
        last, comma, first = x.partition(",")
        return f"{first.strip()} {last.strip()}" if comma else " ".join(x.split())

    def surname(a, b):
        x, y = norm(a).split(), norm(b).split()
        return bool(x and y) and (x[-1] == y[-1] or x[-1] == y[0])

    def like(a, b):
        return bool(a and b) and SequenceMatcher(None, latin(norm(a)), latin(norm(b))).ratio() >= 0.9

    ds, os = names(d), names(o)
    if not ds or not os:
        return ("ambiguous", 0, "") if not ds and not os else ("missing", 95, "") if not ds else ("ambiguous", 50, "")
    dd, od = [norm(display(a)) for a in ds], [norm(display(a)) for a in os]
    if {norm(a) for a in ds} == {norm(a) for a in os} or set(dd) == set(od):
        return ("ambiguous", 55, "") if low else ("confirmed", 99, "")
    if len(ds) == len(os) and all(any(like(a, b) or surname(ar, br) for b, br in zip(od, os)) for a, ar in zip(dd, ds)) and all(any(like(b, a) or surname(br, ar) for a, ar in zip(dd, ds)) for b, br in zip(od, os)):
        return "confirmed", 88, ""
    if all(x in ("unknown", "anonymous", "n n", "various", "n a", "desconocido", "calibre", "mantesh", "chenjin5 com") for x in dd):
        return "mismatch", 92, ""
    if not set(dd) & set(od) and not any(like(a, b) for a in dd for b in od) and not any(surname(a, b) for a in ds for b in os):
        return "mismatch", 92, "author_swap"
    covered = lambda xs, ys: all(any(x == y or like(x, y) or surname(x, y) for y in ys) for x in xs)
    there, back = covered(od, dd), covered(dd, od)
    if there and not back:
        return "mismatch", 88, "author_swap" if any(not any(like(a, b) or surname(a, b) for b in os) for a in ds) else ""
    return ("mismatch", 92, "") if back and not there else ("mismatch", 80, "")


def test_authors_by_brute_force(spark):
    """Every row of the view, and pairs in two scripts: surnames are compared as written."""
    p = view(spark, SF, "pairs")
    rows = [(r["book_id"], r["d_authors"], r["o_authors"], r["low"]) for r in p.select("book_id", "d_authors", "o_authors", "low").collect()]
    made = [("Mikhail Bulgakov", "Булгаков"), ("Mikhail Bulgakov", "Михаил Булгаков"), ("Лев Толстой & Jane Austen", "Lev Tolstoy"), ("Austen", "Jane Austen & Лев Толстой"), ("Ann Lee & Bob Ray", "Bob Ray & Cy Young"), ("Unknown", "Plato"), ("&", "Plato")]
    got = {}
    for df in (p, pairs(spark, [{"d_authors": d, "o_authors": o} for d, o in made])):
        got |= {(df is p, r["book_id"]): (r["verdict"], r["confidence"], r["flag"]) for r in verify.rows(verify.all_verdicts(df), verify.FIELDS).where("field = 'authors'").collect()}
    want = {(True, b): _plain_authors(d, o, low) for b, d, o, low in rows} | {(False, i): _plain_authors(d, o, None) for i, (d, o) in enumerate(made)}
    assert got == want and got[False, 0] == ("mismatch", 92, "author_swap") and got[False, 1] == ("confirmed", 88, "")


def test_roll_up_of_eleven_fields(spark):
    """The rules of the roll-up over the verdicts of every row, and a book whose title is null and empty: nothing to decide."""
    p = view(spark, SF, "pairs")
    values = {"published_date": "date"}
    by = {}
    for r in verify.rows(verify.all_verdicts(p), verify.FIELDS).collect():
        by.setdefault(r["book_id"], {})[r["field"]] = r
    source = {r["book_id"]: r for r in p.collect()}
    for r in verify.roll_up(verify.all_verdicts(p)).collect():
        fields, raw = by[r["book_id"]], source[r["book_id"]]
        decided = [f for f in fields.values() if f["verdict"] != "ambiguous"]
        patched = [f for f in fields.values() if f["verdict"] in ("mismatch", "missing")]
        flags = sorted({f["flag"] for f in fields.values() if f["flag"]})
        empty = lambda x: x is None or x == "" or x == "&"
        doubt = any(f["verdict"] == "ambiguous" and not (empty(raw[f"d_{values.get(n, n)}"]) and empty(raw[f"o_{values.get(n, n)}"])) for n, f in fields.items())
        mean = sum(f["confidence"] for f in decided) // len(decided) if decided else 0
        risky = bool(set(flags) & set(verify.HIGH_RISK))
        action = "needs_review" if risky or doubt else "no_change" if not patched else "suggest_fix" if mean >= 85 else "needs_review" if mean >= 70 else "defer"
        eligible = action == "suggest_fix" and sum(f["confidence"] for f in patched) // len(patched) >= 80 and all(f["confidence"] >= 75 and not f["review"] for f in patched)
        assert (r["confidence"], r["flags"], r["action"], r["eligible"]) == (mean, ",".join(flags), action, eligible), r["book_id"]
    one = pairs(spark, [{"o_title": ""}])
    assert verify.roll_up(verify.all_verdicts(one)).first()["action"] == "no_change"


def _quote(x):
    return repr(x)


def test_reasons_by_hand(spark):
    """One case for each rung that has words of its own."""
    cases = {
        "isbn": [({}, "No ISBN declared and none observed."), ({"o_isbn": "978-0-306-40615-7"}, "Found valid ISBN 9780306406157 on copyright page; not declared in Calibre."), ({"o_isbn": "123"}, "Found ISBN-shaped string '123' but checksum invalid."),
                 ({"d_isbn": "9780306406157", "o_isbn": "9780140328721"}, "ISBN conflict: declared 9780306406157 but book has 9780140328721."), ({"d_isbn": "1", "o_isbn": "9780140328721"}, "Declared ISBN has invalid checksum; book has valid 9780140328721."),
                 ({"d_isbn": "9780306406157", "o_isbn": "12"}, "Observed ISBN 12 has invalid checksum."), ({"d_isbn": "0306406152", "o_isbn": "9780306406157"}, "Declared ISBN-10 converts to observed ISBN-13.")],
        "title": [({"o_title": "It's"}, 'Title found on title page: "It\'s".'), ({"d_title": "Dune [retail]", "o_title": "Dune"}, "Declared title contains scraper/extension junk; canonical title is 'Dune'."), ({"d_title": "Dune!!", "o_title": "Dune"}, "Trailing punctuation noise on declared title."),
                  ({"d_title": "Dune by Frank Herbert", "o_title": "Dune"}, "'by Author' suffix noise on declared title."), ({"d_title": "Dune and what came after it in the desert", "o_title": "Dune"}, "Declared title has edition annotation; canonical is 'Dune'."),
                  ({"d_title": "Dune", "o_title": "Dune and what came after it in the desert"}, "Declared title has noise or annotation; canonical is 'Dune and what came after it in the desert'."), ({"d_title": "Crónica", "o_title": "cronica"}, "Titles match (similarity 1.00)."),
                  ({"d_title": "Pride and Prejudice", "o_title": "War"}, "Titles differ significantly (similarity 0.09)."), ({"d_title": "Dune", "o_title": "Dune", "low": True}, "OCR quality is low; cannot confirm match.")],
        "authors": [({"o_authors": "Ann Lee & Bob O'Hara"}, "Author(s) found on title page: ['Ann Lee', \"Bob O'Hara\"]."), ({"d_authors": "Unknown", "o_authors": "Plato"}, "Declared author is sentinel; book has real author(s): ['Plato']."),
                    ({"d_authors": "Ann Lee", "o_authors": "Plato"}, "Author swap: declared ['Ann Lee'] but book has ['Plato']."), ({"d_authors": "Plato & Ann Lee", "o_authors": "Plato"}, "Declared authors include hallucinated extra(s): ['Ann Lee']."),
                    ({"d_authors": "Plato", "o_authors": "Plato & Ann Lee"}, "Missing co-author(s): ['Ann Lee']."), ({"d_authors": "Plato & Ann Lee", "o_authors": "Plato & Cy Young"}, "Author sets partially overlap.")],
        "publisher": [({"o_publisher": "Penguin"}, "Publisher found on copyright page: 'Penguin'."), ({"d_publisher": "Penguin", "o_publisher": "Penguin Books"}, "Publisher variant only (similarity 0.70)."), ({"d_publisher": "Penguin", "o_publisher": "Orbit"}, "Publisher mismatch (similarity 0.17).")],
        "published_date": [({"d_date": "2019", "o_date": "1990-01-01"}, "Year mismatch: declared 2019, observed 1990."), ({"o_date": "1990"}, "Date found on copyright page: '1990'."), ({"d_date": "x", "o_date": "1990"}, "Date parse failed.")],
        "language": [({"d_language": " EN", "o_language": "Es"}, "Language mismatch: declared en, detected es."), ({"o_language": "Es"}, "Language detected: 'Es'.")],
        "series": [({"sampled": False}, "No series declared; headers not sampled."), ({"d_series": "S"}, "Series declared but no series header on running pages."), ({"o_series": "S"}, "Series header found: 'S'.")],
        "series_index": [({"d_series_index": 1.0, "o_series_index": 2.5}, "Series index mismatch: declared 1.0, observed 2.5."), ({"o_series_index": 3.0}, "Series index found in header: 3.0.")],
        "volume": [({"d_volume": 1.0, "o_volume": 2.6}, "Volume mismatch: declared 1, observed 3."), ({}, "No volume declared and none observed.")],
        "chapter": [({"d_chapter": 1.5, "o_chapter": 1.5}, "Chapter matches (decimal).")], "series_position": [({"d_series_position": 1.5}, "Series position declared but not found in content sample.")],
    }
    flat = [(f, r, w) for f, cs in cases.items() for r, w in cs]
    got = {(x["book_id"], x["field"]): x["reason"] for x in verify.rows(verify.all_verdicts(pairs(spark, [r for _, r, _ in flat])), verify.FIELDS).collect()}
    assert [got[i, f] for i, (f, _, _) in enumerate(flat)] == [w for *_, w in flat]


def test_reasons_of_every_row(spark):
    """Reasons follow from values and verdicts, and a book has those of the fields that have anything to say, in order."""
    p = view(spark, SF, "pairs")
    raw = {r["book_id"]: r.asDict() for r in p.collect()}
    by = {}
    for r in verify.rows(verify.all_verdicts(p), verify.FIELDS).collect():
        by.setdefault(r["book_id"], []).append(r)
    names = lambda x: [a.strip() for a in (x or "").split("&") if a.strip()]
    for b, fields in by.items():
        v = raw[b]
        for r in fields:
            f = r["field"]
            d, o = v[f"d_{'date' if f == 'published_date' else f}"], v[f"o_{'date' if f == 'published_date' else f}"]
            if f == "language" and r["verdict"] == "mismatch":
                assert r["reason"] == f"Language mismatch: declared {d.strip().lower()}, detected {o.strip().lower()}."
            if f == "published_date" and r["verdict"] == "mismatch":
                assert r["reason"] == f"Year mismatch: declared {d[:4]}, observed {o[:4]}."
            if f == "publisher" and r["verdict"] == "missing":
                assert r["reason"] == f"Publisher found on copyright page: {_quote(o)}."
            if f in verify.NUMBERS and r["verdict"] == "mismatch":
                show = (lambda x: str(round(x))) if f == "volume" else str
                assert r["reason"].endswith(f"mismatch: declared {show(d)}, observed {show(o)}.")
            if f == "authors" and r["flag"] == "author_swap" and r["confidence"] == 92:
                assert r["reason"] == f"Author swap: declared {names(d)} but book has {names(o)}."
            assert r["reason"]
    for r in verify.roll_up(verify.all_verdicts(p)).collect():
        v = raw[r["book_id"]]
        want = []
        for f in by[r["book_id"]]:
            key = "date" if f["field"] == "published_date" else f["field"]
            if not (f["verdict"] == "ambiguous" and v[f"d_{key}"] in (None, "") and v[f"o_{key}"] in (None, "")):
                want.append(f"[{f['field']}] {f['reason']}")
        assert r["reasons"] == want
