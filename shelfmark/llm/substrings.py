"""Removal of repeated substrings of `WINDOW` words or more, by difference-cover anchors.

Positions p with p mod 13 in {0, 1, 3, 9} are anchors: every residue is a
difference of two of them, so for any two places i and j there is a shift
below 13 that puts both on an anchor. Two equal 20-word windows therefore share
an aligned anchor, an 8-word sequence inside them. Only anchors are hashed (4 of 13
positions); an anchor whose hash occurs once rules its windows out. Windows
around the other anchors are extended to 20 words, keyed by a 96-bit hash, and
all but the earliest of each key mark their words.

Skew: a passage that a third of all documents hold would send as many rows to
one key. Each slice of a task therefore sends one row for each key; further
occurrences in the slice are already decided there and travel under keys of
their own. No group is gathered; texts cross the network once.

What is decided by hash: equal words and anchors (64 bits), equal windows (95
bits), equal whole texts (128 bits).

Defined results: a null or empty text has no words and keeps none; texts under
20 words are kept; a document is an id and a text: repeated rows of both are one
document, so they don't remove each other, while different texts of one id are
documents in the order of their hash; rows with a null id remove nothing and lose
nothing; an id may have any type that casts to long; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm._text import column_bytes, documents, gram_hashes, mix, signed, slices, span_hashes, word_spans

WINDOW = 20
#: A perfect difference cover: a fixed value.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_cover = np.isin(np.arange(PERIOD), COVER)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = column_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def _ids(part: pa.RecordBatch) -> np.ndarray:
    """Rows without an id have no windows, so what stands for it is never used."""
    return pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _own_marks(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows and places of all marks, without those of other texts of an id."""
    marks = part.column("marks")
    flat = np.asarray(marks.flatten(), np.int64)
    row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    own = flat >> 32 == np.asarray(part.column("twin"), np.int64)[row]
    return row[own], flat[own] & 0xFFFFFFFF


def _earliest(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is the first of its key by (doc, pos), and the size of its key's group."""
    order = np.lexsort((pos, doc, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    d, p = doc[order], pos[order]
    same = (d == d[start][group]) & (p == p[start][group])
    first, count = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
    first[order], count[order] = same, size[group]
    return first, count


def _own(key: np.ndarray, doc: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The key of a row that is decided already depends on its document alone: spread evenly, and small once compressed."""
    return np.where(rest, mix(mix(doc.view(np.uint64)) + np.uint64(0x51ED270B)), key)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        part = part.filter(pc.and_(pc.invert(part.column("copy")), pc.is_valid(part.column("doc_id"))))
        if not part.num_rows:
            continue
        words, first = _words(part.column("text"))
        key, at = gram_hashes(words, first, ANCHOR)
        row = np.searchsorted(first, at, "right") - 1
        pos = at - first[row]
        keep = _cover[pos % PERIOD]
        key, row, pos = key[keep], row[keep], pos[keep]
        pos = pos | np.asarray(part.column("twin"), np.int64)[row] << 32
        doc = _ids(part)[row]
        lead, count = _earliest(key, doc, pos)
        key = _own(key, doc, ~lead)
        yield pa.record_batch([pa.array(signed(key)), pa.array(np.where(count > 1, 2, 1).astype(np.int32)), pa.array(doc), pa.array(pos)], ["key", "weight", "doc_id", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the 20-word windows that hold a repeated anchor."""
    for part in slices(batches):
        at, place = _own_marks(part)
        if not len(at):
            continue
        words, first = _words(part.column("text"))
        anchor = place + first[at]
        spread = np.zeros(len(words) + 1, np.int64)
        np.add.at(spread, np.maximum(anchor - (PERIOD - 1), first[at]), 1)
        np.add.at(spread, anchor + 1, -1)
        likely = np.cumsum(spread)[:-1] > 0
        key, at = gram_hashes(words, first, WINDOW, 1)
        keep = likely[at]
        key, at = key[keep], at[keep]
        extra = span_hashes(mix(words + np.uint64(11)), at, at + WINDOW, 2) >> np.uint64(33)
        row = np.searchsorted(first, at, "right") - 1
        place, doc = at - first[row], _ids(part)[row]
        pos = place | np.asarray(part.column("twin"), np.int64)[row] << 32
        lead, _ = _earliest(key ^ mix(extra), doc, pos)
        key, extra = _own(key, doc, ~lead), np.where(lead, extra, place)
        yield pa.record_batch([pa.array(signed(key)), pa.array(extra.astype(np.int32)), pa.array(~lead), pa.array(doc), pa.array(pos)], ["key", "extra", "known", "doc_id", "pos"])


def told_apart(docs: DataFrame) -> DataFrame:
    """For each id: `first`, the hashes of its texts that no smaller id has, and `several`, whether it has different texts.

    A text that many ids hold is one row after the map-side aggregate, and no row is joined by its text.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    leaders = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "a", F.lit(True).alias("leads"))
    both = leaders.unionByName(keyed.select("doc_id", "a", F.lit(False).alias("leads")))
    return both.groupBy("doc_id").agg(F.collect_set(F.when(F.col("leads"), F.col("a"))).alias("first"), (F.min("a") != F.max("a")).alias("several"))


def repeated(df: DataFrame) -> DataFrame:
    """The rows, `copy`, `twin`, and `marks`: the starts of windows that also start earlier; null if there are none.

    Whole copies are settled first, by the hash of their text; neither they nor,
    on their account, the originals send anchors or windows. `twin` tells texts of
    one id apart (0 where there is one only) and travels as the upper half of `pos`.
    """
    h = F.xxhash64("text")
    docs = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.join(told_apart(docs).hint("shuffle_hash"), "doc_id", "left")
    docs = docs.withColumns({
        "copy": F.coalesce(F.col("text").isNotNull() & ~F.array_contains("first", h), F.lit(False)),
        "twin": F.when(F.coalesce("several", F.lit(False)) & F.col("text").isNotNull(), F.shiftrightunsigned(h, 34) + 1).otherwise(F.lit(0).cast("long")),
    }).drop("first", "several")
    anchors = docs.mapInArrow(_anchors, "key long, weight int, doc_id long, pos long")
    again = anchors.withColumn("n", F.sum("weight").over(Window.partitionBy("key"))).where(F.col("n") > 1).groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    windows = docs.join(again.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_windows, "key long, extra int, known boolean, doc_id long, pos long")
    later = windows.withColumn("n", F.rank().over(Window.partitionBy("key", "extra").orderBy("doc_id", "pos"))).where(F.col("known") | (F.col("n") > 1))
    return docs.join(later.groupBy("doc_id").agg(F.collect_list("pos").alias("marks")).hint("shuffle_hash"), "doc_id", "left")


def _kept(part: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """For each row: words, words removed, words kept."""
    rows, places = _own_marks(part)
    cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
    for i, (text, copy) in enumerate(zip(part.column("text").to_pylist(), part.column("copy").to_pylist())):
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if copy and len(words) >= WINDOW:
            yield len(words), len(words), []
            continue
        at = places[cuts[i] : cuts[i + 1]]
        at = at[at + WINDOW <= len(words)]
        if not len(at):
            yield len(words), 0, words
            continue
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + WINDOW, -1)
        stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
        yield len(words), len(words) - len(stay), [words[i] for i in stay.tolist()]


def digests(df: DataFrame) -> DataFrame:
    """The contract of op2: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gone, sha = [], [], []
            for a, b, words in _kept(part):
                n.append(a)
                gone.append(b)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(documents(df, "doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(df: DataFrame) -> DataFrame:
    """All rows and columns, with repeated windows cut out of the text; texts that lose nothing stay as they are."""
    names = df.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [b" ".join(words).decode("utf-8", "surrogatepass") if gone else text for text, (_, gone, words) in zip(part.column("text").to_pylist(), _kept(part))]
            columns = [part.column(n) for n in names]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names)

    clash = {n: f"{n}_of_caller" for n in ("marks", "copy", "twin", "first", "several") if n in names}
    if clash:  # columns of the caller's with the operator's own names
        return deduplicated(df.withColumnsRenamed(clash)).withColumnsRenamed({b: a for a, b in clash.items()}).select(*names)
    return repeated(df).mapInArrow(run, df.withColumn("doc_id", F.col("doc_id").cast("long")).schema)
