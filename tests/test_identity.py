"""The ladder on books made by hand."""

from shelfmark.operators import identity

KIND = "book_id long, independence_root string, source_kind string, field string, manifestation_isbn string, authoritative boolean, value string"
FORMAT = "book_id long, format string, status string, isbn string, title string, authors string, languages string"
A, B = "9780306406157", "9780000000019"


def test_ladder(spark):
    """One book for each rung."""
    formats, rows = [], []

    def book(n, told=(("one", "provider_structured"),), inner=True, **changes):
        made = {"EPUB": {}, "PDF": {}} | changes.pop("formats", {})
        for name, x in made.items():
            formats.append((n, name, x.get("status", "readable"), x.get("isbn", A), x.get("title", "T"), x.get("authors", "Ann & Bob"), x.get("languages", "en")))
        for root, kind in ([("book", "content_native")] if inner else []) + list(told):
            for f, v in (("identifiers", A), ("title", "t."), ("authors", "BOB & Ann"), ("languages", "EN")):
                v = changes.get(root, {}).get(f, v)
                if v is not None:
                    rows.append((n, root, kind, f, changes.get(root, {}).get("of", A), True, v))

    book(1)
    book(2, formats={"PDF": {"isbn": B}})
    book(3, formats={"PDF": {"status": "protected"}})
    book(4, formats={"EPUB": {"isbn": None}, "PDF": {"isbn": "123"}})
    book(5, inner=False)
    book(6, told=())
    book(7, formats={"PDF": {"title": "Other"}})
    book(8, formats={"PDF": {"languages": ""}})
    book(9, told=(("one", "provider_structured"), ("two", "official_page")), two={"title": "Other"})
    book(10, one={"languages": None})
    book(11, told=(("one", "provider_structured"), ("two", "provider_structured")), two={"title": "Other", "of": B})  # another book's root
    e, f = spark.createDataFrame(rows, KIND), spark.createDataFrame(formats, FORMAT)
    got = {r["book_id"]: (r["tier"], r["reason"]) for r in identity.tiers(e, f).collect()}
    assert [got[n] for n in range(1, 12)] == [
        ("A", "confirmed"), ("C", "format_manifestation_conflict"), ("B", "incomplete_format_evidence"), ("B", "missing_manifestation_identifier"), ("B", "missing_internal_manifestation_confirmation"),
        ("B", "missing_external_manifestation_confirmation"), ("C", "format_expression_conflict"), ("B", "incomplete_internal_core_evidence"), ("C", "external_expression_conflict"),
        ("B", "missing_external_core_confirmation"), ("A", "confirmed"),
    ]
    assert {r["independence_root"] for r in identity.root_matches(e, f).where("book_id = 11").collect()} == {"one"}
    current = spark.createDataFrame([(1, "title", "T"), (1, "languages", "de")], "book_id long, field string, value string")
    got = {(r["book_id"], r["field"]): (r["status"], r["patch"]) for r in identity.decisions(e, f, current).collect()}
    assert got[1, "title"] == ("unchanged", None) and got[1, "languages"] == ("auto", "EN") and got[2, "title"][0] == "blocked" and got[3, "title"][0] == "review"
