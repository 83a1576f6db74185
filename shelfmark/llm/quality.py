"""Quality classification by regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics (logs, square roots
and log-odds of counts, so that the classes are closer to normal). Each class
has a mean and a covariance shrunk towards the pooled diagonal; the score comes
from the difference of the two Gaussian log-densities, by Mahalanobis distances
with Cholesky factors that are computed once and kept. A one-dimensional
logistic fit on the training rows turns the difference into a probability.

All labelled rows are learned from. They stay in Spark: counts, sums and sums of
products of each class reach the driver, of features in whole multiples of 1/UNIT, so no
order of rows changes them; then the counts of the rows' margins in steps of 1/STEP,
which the logistic fit takes.

Defined results: null and empty texts are scored like any other, from zero
statistics; with fewer than two labelled rows in either class the score is the
share of label 1 (0.5 without labels); repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import SPACE, column_bytes, documents, fold, slices, span_hashes, word_spans, written

UNIT, STEP = 1 << 16, 256
SHRINK = 0.1
THRESHOLD = 0.3
FEATURES = ("size", "word_size", "upper", "digit", "mark", "end_mark", "symbol", "bar", "lines", "new_words", "same_words", "same_pairs", "new_lines", "odd", "long_words", "one_letter")

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_kinds = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), np.frombuffer(b".,;:'\"()?-", np.uint8)),
    "end_mark": np.isin(np.arange(256), np.frombuffer(b"!", np.uint8)),
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~/", np.uint8)),
    "bar": np.isin(np.arange(256), np.frombuffer(b"|", np.uint8)),
    "odd": (np.arange(256) < 32) & ~SPACE,
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values in each row's range."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of `FEATURES` for each text."""
    data, offsets = column_bytes(texts)
    size = np.diff(offsets).astype(float)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(float)
    hashes = span_hashes(data, starts, ends)
    length = ends - starts
    row = np.repeat(np.arange(len(size)), np.diff(first))
    inner = np.zeros(len(hashes), bool)
    inner[1:] = row[1:] == row[:-1]
    same = np.zeros(len(hashes), bool)
    same[1:] = inner[1:] & (hashes[1:] == hashes[:-1])
    pair = np.where(inner, hashes ^ np.roll(hashes, 1) * np.uint64(0x9E3779B97F4A7C15), 0)
    ls, le, lf = word_spans(data, offsets, _NEWLINE)
    lines = np.diff(lf).astype(float)
    share = lambda part, whole: np.sqrt(part / np.maximum(whole, 1))
    counts = {k: _per_row(t[data], offsets) for k, t in _kinds.items()}
    by_word = lambda flags: np.bincount(row[flags], minlength=len(size))
    mean = lambda x: np.log1p(x)
    columns = {
        "size": np.log1p(size),
        "word_size": mean(size / np.maximum(words, 1)),
        "lines": mean(words / np.maximum(lines, 1)),
        "new_words": _distinct(hashes, first) / np.maximum(words, 1) ** 0.9,
        "same_words": share(by_word(same), words),
        "same_pairs": (_distinct(pair, first) + 1) / np.maximum(words, 1) ** 0.98,
        "new_lines": share(lines - _distinct(span_hashes(data, ls, le), lf), lines),
        "long_words": share(by_word(length > 24), words),
        "one_letter": share(by_word(length == 1), words),
    } | {k: share(v, size) for k, v in counts.items()}
    return np.stack([columns[k] for k in FEATURES], 1)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the calibration."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    logdets: tuple[float, ...]
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        d = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * g for m, f, g in zip(self.means, self.factors, self.logdets)]
        return np.clip(d[1] - d[0], -200, 200)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """From each class's count, sums and sums of products: covariances shrunk towards the pooled diagonal; not calibrated yet."""
    center = total.sum(0) / count.sum()
    scale = np.sqrt(np.maximum(np.diag(square.sum(0)) / count.sum() - center**2, 0)) + 1e-3
    raw = [t / n for t, n in zip(total, count)]
    own = [(s / n - np.outer(m, m)) / np.outer(scale, scale) for s, n, m in zip(square, count, raw)]
    pooled = np.diag(sum(n * np.diag(c) for n, c in zip(count, own)) / count.sum() + 1e-3)
    factors, logdets = [], []
    for c in own:
        chol = np.linalg.cholesky((1 - shrink) * c + shrink * pooled)
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    return Discriminant(center, scale, tuple((m - center) / scale for m in raw), tuple(factors), tuple(logdets), 1.0, 0.0)


def calibrated(model: Discriminant, m: np.ndarray, y: np.ndarray, count: np.ndarray) -> Discriminant:
    """Logistic fit of the label to margins that occur `count` times each."""
    w = count / count.sum()
    a, b = 0.1, 0.0
    for _ in range(100):  # Newton steps of a ridge logistic regression in two parameters
        p = 1 / (1 + np.exp(-(a * m + b)))
        g = np.array([(w * (p - y) * m).sum() + 1e-6 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p) + 1e-12
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(1e-4, a - step[0]), b - step[1]
    return replace(model, slope=float(a), shift=float(b))


def learn(df: DataFrame, labels: DataFrame, train: Column) -> Discriminant | float:
    """Fit to all labelled rows; the share of label 1 where a class has too few."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(train & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    kind, size = df.schema["doc_id"].dataType.simpleString(), len(FEATURES)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = statistics(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy().reshape(-1, size)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = np.rint(UNIT * values(batch)).astype(np.int64), batch.column("y").to_numpy()
            v = np.stack([np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]) for z in (x[y == 0], x[y == 1])])
            at = np.arange(v.size)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(v.ravel(), pa.int64())], ["at", "v"])

    rows = written(documents(df, "doc_id", "text").where("doc_id is not null").mapInArrow(described, f"doc_id {kind}, x array<double>").join(known.distinct(), "doc_id").select("y", "x"))
    sums = {r["at"]: int(r["v"]) for r in rows.mapInArrow(moments, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect()}  # 2 * (1 + size + size * size) rows
    found = np.array([sums.get(i, 0) for i in range(2 * (1 + size + size * size))], float).reshape(2, -1)
    if found[:, 0].min() < 2:
        everyone = sum(shares.values())
        return shares.get(1, 0) / everyone if everyone else 0.5
    model = fit(found[:, 0], found[:, 1 : 1 + size] / UNIT, found[:, 1 + size :].reshape(2, size, size) / UNIT**2)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("y"), pa.array(np.rint(STEP * model.margin(values(batch))) / STEP)], ["y", "m"])

    levels = rows.mapInArrow(margins, "y int, m double").groupBy("y", "m").count().orderBy("m", "y").collect()  # 2 * (400 * STEP + 1) rows at most
    y, m, n = (np.array([r[k] for r in levels], float) for k in ("y", "m", "count"))
    return calibrated(model, m, y, n)


def score(df: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if isinstance(model, float):
                s = np.full(part.num_rows, model)
            else:
                s = model.score(statistics(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(df: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Learn from the labels outside the held-out fold and score every row: the contract of op5."""
    model = learn(df, labels, fold("doc_id", folds) != held_out)
    return score(df, model).select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")


def keep(df: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the documents, all columns, whose text reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = np.full(part.num_rows, model) if isinstance(model, float) else model.score(statistics(part.column("text")))
            yield part.filter(pa.array(s >= threshold))

    return df.mapInArrow(run, df.schema)
