"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are sets of distinct 5-word shingles. Columns are put in
one global order: n-grams that are frequent over the corpus last, the others by
hash. For 100 * |x ∩ y| >= 75 * |x ∪ y| both sets need an n-gram in common among their
first n - ceil(0.75 n) + 1, so only that part of the incidence is kept, and only
columns that two documents share. The product is taken in blocks of columns
(the shuffle partitions): overlap counts of a pair are accumulated over its
columns. With o the overlap that the sizes demand, the first L common n-grams of
a pair lie among the first n - o + L of either set; a cell further back doesn't
count for that pair, and a pair with less than L such cells is discarded. L is
`COMMON`, or less where the kept prefixes are shorter. Survivors are counted
exactly on their whole sets.

Nothing is quadratic in a group of copies. Equal sets are one class, with the
smallest id as representative (`nodes`). A column first links its classes to its
smallest and its largest only; the product proper runs on columns whose classes
are still in different components after that, and only on pairs across components.
Links between different texts that are left out lie inside a component.

What is decided by hash: equal shingles (64 bits) and equal sets (their size and 128 bits).

Defined results: documents without words (null or empty text) have an empty
set and are components of their own; fewer than five words are one shingle;
repeated rows fall into one class; different texts of one id are documents of
their own, each with its own links; a null id has a null component; an id may
have any type that casts to long; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm._text import column_bytes, documents, gram_hashes, mix, signed, slices, span_hashes, with_group, word_spans
from shelfmark.operators.graph import components, written

GRAM = 5
PERCENT = 75
COMMON = 4
#: Frequent: in more than this share of the documents, at least FLOOR; at most MOST n-grams.
SHARE, FLOOR, MOST = 0.0005, 40, 1 << 20
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, sorted by both."""
    data, offsets = column_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(_lower[data], starts, ends)
    key, at = gram_hashes(words, first, GRAM)
    row = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < GRAM))
    if len(short):
        whole = span_hashes(mix(words), first[short], first[short + 1])
        row, key = np.concatenate((row, short)), np.concatenate((key, whole))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _signatures(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Rows, hashes, sizes and a 128-bit signature of each row's set."""
    row, key = shingles(part.column("text"))
    n = np.bincount(row, minlength=part.num_rows)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(key), dtype=np.uint64)))
    mixed = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(mix(key + np.uint64(0x51ED270B)))))
    edge = np.concatenate(([0], np.cumsum(n)))
    return row, key, n, total[edge[1:]] - total[edge[:-1]], mixed[edge[1:]] ^ mixed[edge[:-1]]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0) and for each n-gram that is frequent within a slice (kind 1)."""
    for part in slices(batches):
        _, key, n, a, b = _signatures(part)
        gram, count = np.unique(key, return_counts=True)
        gram, count = gram[count > 2], count[count > 2]
        k = len(gram)
        kind = np.repeat(np.array([0, 1], np.int8), [len(n), k])
        ids, texts = (pa.concat_arrays([part.column(c), pa.nulls(k, pa.int64())]) for c in ("doc_id", "t"))
        yield pa.record_batch([pa.array(kind), ids, texts, pa.array(np.concatenate((n, count))), pa.array(signed(np.concatenate((a, gram)))), pa.array(signed(np.concatenate((b, np.zeros(k, np.uint64)))))], ["kind", "doc_id", "t", "n", "a", "b"])


def incidence(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(gram, doc_id, cell): the prefix of each set in the global order; equal sets of a slice once.

    A cell holds the set's size (upper half) and the n-gram's place in it (lower half).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, key, n, a, b = _signatures(part)
            _, one = np.unique(np.stack((n.astype(np.uint64), a, b), 1), axis=0, return_index=True)
            leads = np.zeros(part.num_rows, bool)
            leads[one] = True
            at = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
            late = frequent[at] == key if len(frequent) else np.zeros(len(key), bool)
            order = np.lexsort((key, late, row))
            row, key = row[order], key[order]
            place = np.arange(len(row)) - np.concatenate(([0], np.cumsum(n)))[row]
            keep = leads[row] & (place <= n[row] + (-PERCENT * n[row]) // 100)
            row, key, cell = row[keep], key[keep], n[row[keep]] << 32 | place[keep]
            yield pa.record_batch([pa.array(signed(key)), part.column("doc_id").take(pa.array(row)), pa.array(cell)], ["gram", "doc_id", "cell"])

    return docs.mapInArrow(run, "gram long, doc_id long, cell long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "left", 2 << 20):
            (ra, ka), (rb, kb) = shingles(part.column("left")), shingles(part.column("right"))
            row, key = np.concatenate((ra, rb)), np.concatenate((ka, kb))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            both = row[1:][(row[1:] == row[:-1]) & (key[1:] == key[:-1])]
            shared = np.bincount(both, minlength=part.num_rows)
            union = np.bincount(row, minlength=part.num_rows) - shared
            yield part.select(["x", "y"]).filter(pa.array((100 * shared >= PERCENT * union) & (union > 0)))

    one = texts.select(F.col("node").alias("id"), "text")
    left = pairs.join(one, F.col("x") == F.col("id")).select("x", "y", F.col("text").alias("left"))
    return left.join(one, F.col("y") == F.col("id")).select("x", "y", "left", F.col("text").alias("right")).mapInArrow(run, "x long, y long")


def nodes(rows: DataFrame) -> DataFrame:
    """A row for each class of equal sets: n, a, b, size, class_id, t (the hash of the text that stands for it) and node.

    The node is the class's smallest id; where several classes have the same
    smallest id (different texts of one id), all but one take a negative hash.
    """
    first = rows.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "t")).alias("first")).select("n", "a", "b", "size", F.col("first.doc_id").alias("class_id"), "first.t")
    sign = F.struct("n", "a", "b")
    owner = first.groupBy(F.col("class_id").alias("c")).agg(F.min(sign).alias("owner"))
    node = F.when(F.col("owner") == sign, F.col("class_id")).otherwise(-1 - F.abs(F.shiftright(F.xxhash64("class_id", "n", "a", "b"), 1)))
    return first.join(owner, F.col("class_id") == F.col("c")).select(*first.columns, node.alias("node"))


def grouped(df: DataFrame) -> DataFrame:
    """doc_id and t (the hash of the text) of every row, n_shingles, component_id, class_id, and `group`, a number of its component alone; null without words."""
    docs = documents(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    told = written(docs.mapInArrow(_described, "kind byte, doc_id long, t long, n long, a long, b long"))
    rows = told.where("kind = 0").select("doc_id", "t", "n", "a", "b")
    least = F.lit(max(FLOOR, int(SHARE * rows.count())))
    heavy = told.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a").limit(MOST)
    frequent = np.sort(np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in heavy.select("a").toArrow().column("a").chunks)]).view(np.uint64))  # MOST at most

    named = written(nodes(rows))
    classes = written(with_group(rows, named.drop("t"), ["n", "a", "b"], "size").select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), "node"))

    shared = incidence(docs.where("doc_id is not null").select("doc_id", "text"), frequent).withColumn("c", F.count("*").over(Window.partitionBy("gram"))).where("c > 1").select("gram", "doc_id", "cell")
    size, place = F.shiftright("cell", 32).cast("int").alias("n"), F.col("cell").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place")
    by_class = shared.join(classes.where("node is not null").select("doc_id", "node").distinct(), "doc_id").select("gram", F.col("node").alias("x"), size, place).distinct()
    column = Window.partitionBy("gram")
    end = F.struct("x", "n", "place")
    cells = written(by_class.withColumn("lo", F.min(end).over(column)).withColumn("hi", F.max(end).over(column)).where(F.col("lo.x") < F.col("hi.x")))

    apart = 100 * F.least("n", "yn") >= PERCENT * F.greatest("n", "yn")
    need = F.ceil(PERCENT * (F.col("n") + F.col("yn")) / (100 + PERCENT))
    common = F.least(F.lit(COMMON), need - F.ceil(PERCENT * F.greatest("n", "yn") / 100) + 1)
    early = (F.col("place") < F.col("n") - need + common) & (F.col("yplace") < F.col("yn") - need + common)
    ends = cells.select("x", "n", "place", F.explode(F.array("lo", "hi")).alias("p")).select("x", "n", "place", F.col("p.x").alias("y"), F.col("p.n").alias("yn"), F.col("p.place").alias("yplace")).where("x <> y")
    stars = ends.where(apart & early).groupBy("x", "y", "n", "yn").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= common).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    stand = named.join(cells.select(F.col("x").alias("node")).distinct(), "node", "left_semi").select(F.col("class_id").alias("doc_id"), "t", "node")
    texts = written(docs.join(stand, ["doc_id", "t"]).dropDuplicates(["node"]))  # repeated rows only: one id and text
    found = written(linked(stars, texts))
    labels = components(found)

    at = cells.select("gram", "x", "n", "place").join(labels, F.col("x") == F.col("id"), "left").select("gram", "x", "n", "place", F.coalesce("component", "x").alias("k"))
    open_ = written(at.withColumn("a", F.min("k").over(column)).withColumn("b", F.max("k").over(column)).where("a < b").drop("a", "b"))
    other = open_.select(F.col("gram").alias("g"), F.col("x").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yplace"), F.col("k").alias("yk"))
    product = open_.join(other, (F.col("gram") == F.col("g")) & (F.col("x") < F.col("y")) & (F.col("k") != F.col("yk")) & apart & early).groupBy("x", "y", "n", "yn").agg(F.count("*").alias("overlap"))
    across = linked(product.where(F.col("overlap") >= common).select("x", "y").distinct(), texts)
    labels = written(components(found.unionByName(across)))
    labels = labels.unionByName(labels.where("component < 0").select(F.col("component").alias("id"), "component").distinct())
    # The smallest node of a component is its smallest id, but where a node is a hash.
    odd, even = labels.where("component < 0"), labels.where("component >= 0")
    hashed = odd.join(named.select("node", F.col("class_id").alias("c")), F.col("id") == F.col("node")).groupBy(F.col("component").alias("k")).agg(F.min("c").alias("least"))
    labels = even.select("id", F.col("component").alias("group"), F.col("component").alias("component_id")).unionByName(
        odd.join(hashed, F.col("component") == F.col("k")).select("id", F.col("component").alias("group"), F.col("least").alias("component_id"))
    )
    known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return classes.join(labels, F.col("node") == F.col("id"), "left").select(
        "doc_id", "t", "n_shingles", known(F.coalesce("component_id", "class_id")).alias("component_id"), known(F.col("class_id")).alias("class_id"), F.coalesce("group", "node").alias("group")
    )


def near_duplicates(df: DataFrame) -> DataFrame:
    """The contract of op3: doc_id, n_shingles, component_id, and class_id, the smallest id with an equal set."""
    return grouped(df).select("doc_id", "n_shingles", "component_id", "class_id")


def keep_one(df: DataFrame) -> DataFrame:
    """All columns of one row of each group of near duplicates: the one with the smallest id, of several texts of that id the one with the smallest hash.

    Of repeated rows (one id and text), with or without words, any one stays. Rows without an id all stay.
    """
    told = written(grouped(df).where("doc_id is not null").groupBy("doc_id", "t").agg(F.min("group").alias("group"), F.count("*").alias("n")))
    lead = told.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "t", "n")).alias("r")).select("r.*")
    near_id, near_t, again = (next(n for n in (f"_near_{c}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for c in ("id", "t", "again"))  # names that the input doesn't have
    stay = lead.unionByName(told.where("group is null").drop("group")).select(F.col("doc_id").alias(near_id), F.col("t").alias(near_t), (F.col("n") > 1).alias(again))
    both = df.join(stay, (F.col("doc_id").cast("long") == F.col(near_id)) & (F.xxhash64("text") == F.col(near_t)), "left")
    kept = both.where(F.col("doc_id").isNull() | F.col(again).isNotNull())
    once = kept.where(F.col(again)).dropDuplicates([near_id, near_t])
    return kept.where(F.col(again).isNull() | ~F.col(again)).unionByName(once).select(*df.columns)
