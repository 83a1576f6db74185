"""Mining by hand-made pages: entities, page classes, and years by page order."""

import html

from pyspark.sql import functions as F

from shelfmark.operators import mining


def pages(spark, *books):
    return spark.createDataFrame([(b, i, "body", t) for b, ts in enumerate(books) for i, t in enumerate(ts)], "book_id long, seq int, source string, text string")


def by_book(df):
    return {r["book_id"]: r for r in df.collect()}


def test_entities(spark):
    texts = ["&eacute;&#233;&#x27;&#X41;&amp;lt;", "a & b &nosuch; &amp", "&#0;&#55296;&#1114112;&#128;&#x80;", "&copy;&middot;&nbsp;|&quot;&apos;&NotEqualTilde;", "plain", "", "&;&#;&#x;", "&lt;b&gt;&#128512;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", mining.unescaped(F.col("t")).alias("u")).collect()}
    want = [html.unescape(t) for t in texts]
    want[1] = "a & b &nosuch; &amp"  # only entities that end in ; are read
    assert [got[i] for i in range(len(texts))] == want
    assert spark.range(1).select(mining.stripped(F.lit("<p>a&lt;b&gt;</p><!-- x --><script>y</script>&eacute;"))).first()[0] == "a<b>é"


def test_page_classes(spark):
    got = by_book(mining.edition_pages(pages(
        spark,
        ["Title", "All rights reserved.", "Copyright © 1. Se terminó de imprimir"],  # a second copyright page that is a colophon too
        ["COLOFÓN", "Talleres de Luz", "x"],  # a second short colophon is taken as title page
        ["All rights reserved. Se terminó de imprimir", "TALLERES DE Sol"],
        ["x", "y"], ["w " * 120, "All rights reserved", "w " * 120, "title too late"],
    )))
    assert [tuple(got[b])[1:] for b in range(4)] == [(1, 2, 0), (None, 0, 1), (0, 1, None), (None, None, 0)]
    assert tuple(got[4])[1:] == (1, None, None)


def test_years_by_page_order(spark):
    got = by_book(mining.imprint(pages(
        spark, ["Depósito legal: M-1234-2017. Copyright 2019."], ["Copyright 2019", "D.L.: B 55-07"], ["DEPÓSITO LEGAL: M-1234-62"], ["1999 and 2001 and 2099"], ["x", "Published by Autor de libros, 1990", "EDITORIAL Sol de Día.\n2000"],
    )))
    assert [(got[b]["deposit"], got[b]["year"]) for b in range(4)] == [("M-1234-2017", 2017), ("B-55-2007", 2019), ("M-1234-62", 62), (None, 2001)]
    assert (got[4]["publisher"], got[4]["year"]) == ("Sol de Día", 1990)
