"""Vectorised helpers over Arrow string columns, shared by the operators.

Everything here works on the UTF-8 bytes of a whole column at once. Word
separators of all callers are ASCII, so a byte table decides them and no
multi-byte character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import scratch as scratch
from shelfmark.operators.graph import written as written

#: \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns of the input can't clash."""
    return df.select(*columns)


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = 1_000_000) -> DataFrame:
    """`rows` left-joined with `groups` (one row for each key, with its `size`), where a key may hold a third of all rows.

    Groups of `hot` rows and more are broadcast: there are at most rows / `hot` of them. The others are joined by shuffle.
    """
    more = [c for c in groups.columns if c not in (*keys, size)]
    big = groups.where(F.col(size) >= hot).select(*keys, *[F.col(c).alias(f"{c}_hot") for c in more], F.lit(True).alias("is_hot"))
    told = rows.join(F.broadcast(big), keys, "left")
    spread = told.where("is_hot").select(*rows.columns, *[F.col(f"{c}_hot").alias(c) for c in more])
    rest = told.where("is_hot is null").select(*rows.columns).join(groups.where(F.col(size) < hot).drop(size), keys, "left").select(*rows.columns, *more)
    return spread.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row its range of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[-1] = True
    after = np.concatenate(([False], inside[:-1]))
    before = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (edge[:-1] | ~after))
    ends = np.flatnonzero(inside & (edge[1:] | ~before)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for b in (_BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; spans are in order of start and end."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        s, e = starts[at:stop] - base, ends[at:stop] - base
        part = values[base : ends[stop - 1]].astype(np.uint64) + np.uint64(2 * seed + 1)
        power, inverse = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        out[at:stop] = mix((total[e] - total[s]) * inverse[s] + np.uint64(seed) + (e - s).astype(np.uint64) * _M2)
        at = stop
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a row, and the word each starts at.

    `first`: each row's range of words. Rows of fewer words have no window.
    """
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    at = np.arange(total) + shift
    return span_hashes(mix(words + np.uint64(seed)), at, at + n, seed), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the folds of the labelled operators."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
