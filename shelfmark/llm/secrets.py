"""Secret scans: fixed patterns, and a character convolutional network for what they miss.

The patterns give the base spans. They and every other candidate (a token of 6
characters with a digit in it, or of 12 letters) are read by the network together with
their surrounding context, long tokens in several windows that cover them: each
character becomes one of `CLASSES`, an embedding and a width-5 convolution
follow, then a maximum over the token's positions and a logistic unit, whose log-odds
are rounded to `STEP`ths. It is trained on labelled findings: spans of the patterns
against candidates that no pattern marks, but for those that look like keys themselves
(`like_key`): what they are isn't known. Key words before a span are cut out in
training, so the network must judge the token itself.

All findings of all documents are learned from; those that the network sees alike are
one. They stay in Spark, stored in blocks: in each round the tasks sum the loss's gradient
over the findings outside a third that is held out by hash, as whole numbers, so no order
of rows changes the sum, and the driver makes one step of Adam. Every sort of finding (a
pattern's kind; others with a digit; others of letters) weighs the same on its side.
The held-out third is counted by sort and log-odds, and these counts, which are exact and
bounded, give the calibration (logistic) and the threshold. It keeps at least `RECALL`
of the held-out findings of every kind: it lies midway, in log-odds, between the level
that does so and the level that only `FALSE` of the others pass, or at the former where
these cross. `recall` and `false` of the network are the held-out rates at the threshold.

Defined results: null and empty texts have no spans; with no findings of
either label nothing is added to the base and base spans score 0; repeated rows give
repeated rows; the search is linear in a text, whatever its tokens' length;
extra columns are ignored; spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import column_bytes, documents, slices, word_spans, written

KINDS = ("assign", "access", "hex", "learned")
RECALL, FALSE = 0.95, 0.002
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
FILTERS, EMBED, REACH = 24, 8, 5
PLACES = WIDTH - REACH + 1
#: Places in a maximum's lowest bits count down, so that of equal ones the first is chosen; no place is above all.
LAST, NOWHERE = PLACES - 1, 63
#: Windows that the network reads at once; bytes of text that are searched at once, or one text.
BLOCK, SLICE = 2048, 1 << 20
#: Rounds of training at most, its rate, and the loss at which it ends.
ROUNDS, RATE, ENOUGH = 48, 0.05, 0.002
#: Log-odds are whole multiples of 1/STEP, within EDGE.
STEP, EDGE = 256, 60
#: Sums over findings are whole multiples of 1/UNIT; pulls are rounded to 1/FINE.
UNIT, FINE = 1 << 44, 1 << 10

_assign = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_names = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_access = re.compile(b"AKIA[A-Z0-9]{16,}")
_hex = re.compile(b"[0-9a-f]{24,}")
_LEAST, _LETTERS, _ACCESS, _HEX = 6, 12, 20, 24


def _bytes(*ranges: str) -> np.ndarray:
    """A table of the bytes in these ranges, numbered from 1."""
    out = np.zeros(256, np.uint8)
    for i, r in enumerate(ranges, 1):
        out[list(r.encode())] = i
    return out


_lower, _upper, _digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Bytes that end a token, and letters and digits by sort.
_apart = _bytes(_lower + _upper + _digits + "+/_=-") == 0
_sort = _bytes(_lower, _upper, _digits).tobytes()
#: Bytes of a code point but its first.
_inner = bytes(range(0x80, 0xC0))

#: Characters by what they are; code points of 128 and over are letters of text.
_class = np.full(129, 1, np.int64)
for _i, _chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r", "=:", "\"'", "+/", "_-", ".,;!?"), 2):
    for _c in _chars:
        _class[ord(_c)] = _i
_class[128] = 14
CLASSES = 15
#: The same of a code point's first byte; NUL counts as no character.
_lead = bytes([0, *_class[np.minimum(np.arange(1, 256), 128)].tolist()])


class Found:
    """Base spans and candidates of a column of texts, found in their bytes at once; places are code points of the whole column.

    Spans (row, start, kind, end; token: where what the network judges starts) are sorted by start and kind. Candidates are
    the runs of token characters of at least 6 characters with a digit among them, or of at least 12 without, if any is a letter or digit.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = column_bytes(texts)
        raw = data.tobytes()
        inner = np.flatnonzero((data & 0xC0) == 0x80)
        point = lambda at: at - np.searchsorted(inner, at)
        self.classes, self.edges = np.frombuffer(raw.translate(_lead, _inner), np.int8), point(offsets)

        starts, ends, _ = word_spans(data, offsets, _apart)
        long = np.flatnonzero(ends - starts >= _LEAST)
        starts, ends = starts[long], ends[long]
        self.row, at, token, end, self.kind = self._spans(raw, offsets, starts, ends).T
        self.start, self.token, self.end = point(at), point(token), point(end)

        sort = np.frombuffer(raw.translate(_sort), np.uint8)
        digits = np.flatnonzero(sort == 3)
        digit = np.searchsorted(digits, ends) > np.searchsorted(digits, starts)
        n = ends - starts
        ok = digit | (n >= _LETTERS)
        starts, n, digit = starts[ok], n[ok], digit[ok]
        first = np.cumsum(n) - n
        sort = sort[np.repeat(starts - first, n) + np.arange(n.sum())]  # of the tokens only
        change = np.append((sort[:-1] != sort[1:]) & (sort[:-1] > 0) & (sort[1:] > 0), [False] * min(len(n), 1))
        change[first + n - 1] = False
        some = np.maximum.reduceat(sort, first) > 0 if len(n) else digit
        changes = np.add.reduceat(change, first, dtype=np.int64) if len(n) else n
        # like a key: small letters, capitals and digits mix; after one in four at least another sort follows
        like_key = (n >= 12) & (4 * changes >= n - 1)
        self.candidates = np.stack([np.searchsorted(offsets, starts, "right") - 1, point(starts), point(starts + n)], 1)
        self.candidates, self.digit, self.like_key = (v[some] for v in (self.candidates, digit, like_key))
        last = np.maximum.accumulate(self.end)
        before = np.searchsorted(self.start, self.candidates[:, 2])
        #: Which candidates overlap no span.
        self.beside = (before == 0) | (np.append(last, 0)[before - 1] <= self.candidates[:, 1])

    @staticmethod
    def _spans(data: bytes, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row, start, token's start, end and kind of the patterns' matches in bytes; a match that is too short is dropped with what it took.

        `starts` and `ends`: runs of token characters; the patterns for access and hex match inside one.
        """
        out, low, done = [], data.lower(), 0
        at = []
        for name in _names:
            k = low.find(name)
            while k >= 0:
                at.append(k)
                k = low.find(name, k + 1)
        at.sort()
        stop = offsets[np.searchsorted(offsets, at, "right")].tolist() if at else []
        for a, b in zip(at, stop, strict=True):
            if a >= done and (m := _assign.match(data, a, b)):
                done = m.end()
                if m.end() - m.start(2) >= 6:
                    out.append((a, m.start(2), done, 0))
        n = ends - starts
        for kind, pattern, least in ((1, _access, _ACCESS), (2, _hex, _HEX)):
            if kind == 1 and b"AKIA" not in data:
                continue
            for a, b in zip(starts[n >= least].tolist(), ends[n >= least].tolist(), strict=True):
                out += [(m.start(), m.start(), m.end(), kind) for m in pattern.finditer(data, a, b)]
        out.sort(key=lambda x: (x[0], x[3], x[2]))
        found = np.array(out, np.int64).reshape(-1, 4)
        return np.concatenate([np.searchsorted(offsets, found[:, :1], "right") - 1, found], 1)

    def windows(self, row: np.ndarray, left: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of tokens and their context, of which what is before ends at `left`; and each token's number of windows.

        One, or for a token over `INSIDE` several that overlap by half and cover it whole.
        """
        n = end - start
        over = np.maximum(n - INSIDE, 0)
        count = -(-over // (INSIDE // 2)) + 1
        which = np.repeat(np.arange(len(n)), count)
        first = np.minimum((np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * (INSIDE // 2), over[which])
        x = np.empty((len(which), WIDTH), np.int8)
        column = np.arange(WIDTH)
        for i in range(0, len(which), 1 << 15):
            w = which[i : i + (1 << 15)]
            p = first[i : i + (1 << 15), None] + column
            at = p + (start[w] - BEFORE)[:, None]
            at[:, :BEFORE] = np.where(p[:, :BEFORE] < BEFORE, p[:, :BEFORE] + (left[w] - BEFORE)[:, None], at[:, :BEFORE])
            short = n[w] < INSIDE
            at[short, BEFORE + INSIDE :] = end[w[short], None] + np.arange(AFTER)
            off = (at < self.edges[row[w], None]) | (at >= self.edges[row[w] + 1, None])
            off[:, BEFORE : BEFORE + INSIDE] |= short[:, None] & (np.arange(INSIDE) >= n[w, None])
            part = self.classes.take(at, mode="clip") if len(self.classes) else np.zeros(at.shape, np.int8)
            part[off] = 0
            x[i : i + (1 << 15)] = part
        return x, count


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, sorted."""
    f = Found(pa.array([text], pa.string()))
    return list(zip(f.start.tolist(), f.kind.tolist(), f.end.tolist(), strict=True))


def candidates(text: str) -> list[tuple[int, int]]:
    """Every candidate, whether or not it overlaps a span."""
    return [(a, b) for _, a, b in Found(pa.array([text], pa.string())).candidates.tolist()]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """The windows of one token."""
    return Found(pa.array([text], pa.string())).windows(*(np.array([x]) for x in (0, start, start, end)))[0]


@dataclass
class Network:
    """Embedding, convolution, maximum, logistic unit; then calibration, and the threshold of the log-odds before it."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = np.inf
    recall: dict[int, float] | None = None
    false: float = 0.0

    def best(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each filter's maximum over the windows' positions, 0 at least, in whole multiples of the unit returned; its lowest six bits tell the place.

        Embedding and convolution are sums of tables: of the first three characters of a patch, and of the last two. A
        token's end that is filled up has one value at all places, so windows are taken by the length of what isn't.
        """
        t = np.einsum("ce,ref->rcf", self.embed, self.kernel.reshape(REACH, EMBED, FILTERS))
        left = (t[0][:, None, None] + t[1][:, None] + t[2] + self.bias).reshape(-1, FILTERS)
        right = (t[3][:, None] + t[4]).reshape(-1, FILTERS)
        scale = 2.0 ** (24 - np.ceil(np.log2(np.abs(left).max() + np.abs(right).max() + 1e-9)))  # sums are under 2^25
        left, right = (np.rint(scale * side).astype(np.int32) << 6 for side in (left, right))
        out = np.empty((len(x), FILTERS), np.int32)
        for i in range(0, len(x), BLOCK):
            part = x[i : i + BLOCK]
            filled = part[:, BEFORE + INSIDE - 1 : BEFORE - 1 : -1] != 0
            size = np.where(filled.any(1), INSIDE - filled.argmax(1), 0)
            order = np.argsort(-size, kind="stable")
            c = np.ascontiguousarray(part[order].T).astype(np.intp)
            first, last = (c[:-4] * CLASSES + c[1:-3]) * CLASSES + c[2:-2], c[3:-1] * CLASSES + c[4:]
            longer = len(part) - np.cumsum(np.bincount(size, minlength=INSIDE + 1))  # rows of over so many
            best = np.full((len(part), FILTERS), NOWHERE, np.int32)
            h, more = np.empty_like(best), np.empty_like(best)
            for k in range(PLACES):
                n = longer[k - BEFORE] if BEFORE <= k <= BEFORE + INSIDE - REACH else len(part)
                left.take(first[k, :n], 0, h[:n], "clip")
                (right + (LAST - k)).take(last[k, :n], 0, more[:n], "clip")
                h[:n] += more[:n]
                np.maximum(best[:n], h[:n], best[:n])
            n = longer[INSIDE - REACH]
            np.maximum(best[n:], left[0] + right[0] + (LAST - (BEFORE + INSIDE - REACH)), best[n:])
            out[i + order] = best
        return out, 1 / scale

    def odds(self, best: np.ndarray, unit: float) -> np.ndarray:
        top = (best >> 6) * unit
        return np.rint(STEP * np.clip((top * self.out[:-1]).sum(1) + self.out[-1], -EDGE, EDGE)) / STEP

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def packed(found: DataFrame) -> DataFrame:
    """The findings in blocks of one row: sort, count (of windows) and win of each as arrays in bytes; and held, where findings have it."""
    has = "held" in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "win"):
            for held in (False, True):
                rows = part.filter(pc.equal(part.column("held"), held)) if has else part
                if rows.num_rows and (has or not held):
                    count = pc.divide(pc.binary_length(rows.column("win")), WIDTH).to_numpy().astype(np.int32)
                    blob = rows.column("sort").to_numpy().astype(np.int8).tobytes(), count.tobytes(), b"".join(rows.column("win").to_pylist())
                    yield pa.record_batch([pa.array([x], pa.binary()) for x in blob] + [pa.array([held])], ["sort", "count", "win", "held"])

    return found.mapInArrow(run, "sort binary, count binary, win binary, held boolean")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """sort and count of each finding, and all windows, of each row of `packed`."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("sort", "count", "win")), strict=True):
            sort, count, win = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int8, np.int32, np.int8), strict=True))
            yield sort, count, win.reshape(-1, WIDTH)


def judged(net: Network, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each finding, the window of the largest log-odds: its classes, log-odds and maxima; and these' unit."""
    best, unit = net.best(x)
    z = net.odds(best, unit)
    if len(count) == len(x):
        return x, z, best, unit
    chosen = np.lexsort((z, np.repeat(np.arange(len(count)), count)))[np.cumsum(count) - 1]
    return x[chosen], z[chosen], best[chosen], unit


SIZES = (REACH * CLASSES * FILTERS, FILTERS, FILTERS + 1, 1)


def slope(found: DataFrame, net: Network, weight: dict[int, float]) -> tuple[dict[str, np.ndarray], float]:
    """The gradient of the weighted loss over all findings (or their blocks), and the loss: `sum(SIZES)` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, out, loss = (np.zeros(n) for n in SIZES[1:])  # whole numbers under 2^53
        firsts, lasts = np.zeros(CLASSES**3 * FILTERS), np.zeros(CLASSES**2 * FILTERS)  # of a patch's first three characters, and its last two
        for sort, count, win in blocks(batches):
            x, z, best, unit = judged(net, win, count)
            w, y = np.zeros(len(sort)), sort >= 0
            for k, v in weight.items():
                w[sort == k] = UNIT * v
            loss += np.rint(w * np.logaddexp(0, np.where(y, -z, z))).sum()
            g = np.rint(np.rint(FINE * (1 / (1 + np.exp(-z)) - y)) * (w / FINE))
            pull = np.flatnonzero(g)
            g, x, best = g[pull], x[pull], best[pull]
            out += np.append(np.rint((best >> 6) * unit * g[:, None]).sum(0), g.sum())
            row, f = np.nonzero(best & 63 != NOWHERE)
            into = np.rint(g[row] * net.out[f])
            at = row * WIDTH + LAST - (best[row, f] & 63)
            c = [x.ravel().take(at + r).astype(np.int64) for r in range(REACH)]
            firsts += np.bincount(((c[0] * CLASSES + c[1]) * CLASSES + c[2]) * FILTERS + f, into, len(firsts))
            lasts += np.bincount((c[3] * CLASSES + c[4]) * FILTERS + f, into, len(lasts))
            bias += np.bincount(f, into, FILTERS)
        firsts, lasts = firsts.reshape(*[CLASSES] * 3, FILTERS), lasts.reshape(CLASSES, CLASSES, FILTERS)
        patches = np.concatenate([firsts.sum((1, 2)), firsts.sum((0, 2)), firsts.sum((0, 1)), lasts.sum(1), lasts.sum(0)]).ravel()
        total = np.concatenate([patches, bias, out, loss])
        has = np.flatnonzero(total)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(total[has].astype(np.int64))], ["at", "v"])

    found = found if "count" in found.columns else packed(found)
    total = np.zeros(sum(SIZES))
    for r in found.mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"] / UNIT
    patches, bias, out, loss = np.split(total, np.cumsum(SIZES)[:-1])
    t, kernel = patches.reshape(REACH, CLASSES, FILTERS), net.kernel.reshape(REACH, EMBED, FILTERS)
    return {"embed": np.einsum("rcf,ref->ce", t, kernel), "kernel": np.einsum("ce,rcf->ref", net.embed, t).reshape(net.kernel.shape), "bias": bias, "out": out}, float(loss[0])


def train(found: DataFrame, weight: dict[int, float], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Adam on the gradient over all of `found`."""
    r = np.random.default_rng(seed)
    net = Network(r.normal(0, 0.5, (CLASSES, EMBED)), r.normal(0, 0.2, (REACH * EMBED, FILTERS)), np.zeros(FILTERS), np.append(r.normal(0, 0.3, FILTERS), 0.0))
    names = ("embed", "kernel", "bias", "out")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    for t in range(1, rounds + 1):
        grads, loss = slope(found, net, weight)
        if loss < ENOUGH:
            break
        moved = {}
        for n in names:
            d = grads[n] + 1e-5 * getattr(net, n)
            first[n] = 0.9 * first[n] + 0.1 * d
            second[n] = 0.99 * second[n] + 0.01 * d * d
            moved[n] = getattr(net, n) - RATE * min(1.0, 2 - 2 * t / (rounds + 1)) * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-8)
        net = Network(**moved)  # a new one: tasks may still hold the old
    return net


def ranked(z: np.ndarray, n: np.ndarray, share: float, up: bool = False) -> float:
    """The quantile of values that occur n times each, sorted: of two neighbours the lower, or the upper."""
    place = share * (n.sum() - 1)
    return float(z[np.searchsorted(np.cumsum(n), np.ceil(place) if up else np.floor(place), "right")])


def settled(net: Network, held: DataFrame) -> Network:
    """The network with calibration and threshold by all held-out findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sort, count, win in blocks(batches):
            yield pa.record_batch([pa.array(sort, pa.int32()), pa.array(judged(net, win, count)[1])], ["sort", "z"])

    levels = held.mapInArrow(run, "sort int, z double").groupBy("sort", "z").count().orderBy("z", "sort").collect()  # 5 * (2 * EDGE * STEP + 1) rows at most
    sort, z, n = (np.array([r[k] for r in levels]) for k in ("sort", "z", "count"))
    y = sort >= 0
    yes, no = n[y].sum(), n[~y].sum()
    aim = np.where(y, (yes + 1) / (yes + 2), 1 / (no + 2))  # as Platt: no slope without end where the sides part
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of a logistic fit, bounded
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g, v = n * (p - aim), n * p * (1 - p)
        step = np.linalg.solve([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]], [(g * z).sum(), g.sum()])
        step *= min(1.0, 1 / max(np.abs(step).max(), 1e-12))
        a, b = max(0.05, a - step[0]), b - step[1]
    kinds = {int(k): (z[sort == k], n[sort == k]) for k in np.unique(sort[y])}
    keeps, clean = min(ranked(*q, 1 - RECALL) for q in kinds.values()), ranked(z[~y], n[~y], 1 - FALSE, up=True)
    threshold = (keeps + clean) / 2 if keeps > clean else keeps
    passed = lambda q, m: float(m[q >= threshold].sum() / m.sum())
    return replace(net, slope=float(a), shift=float(b), threshold=threshold, recall={k: passed(*q) for k, q in kinds.items()}, false=passed(z[~y], n[~y]))


def findings(df: DataFrame) -> DataFrame:
    """sort (a pattern's kind; -1 with a digit, -2 of letters), win (the classes of all windows) of every labelled finding of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            f = Found(part.column("text"))
            other = f.beside & ~f.like_key
            row, start, end = f.candidates[other].T
            x, count = f.windows(*(np.concatenate(q) for q in ((f.row, row), (f.start, start), (f.token, start), (f.end, end))))
            sort = np.concatenate([f.kind, np.where(f.digit[other], -1, -2)])
            cuts = np.append(0, np.cumsum(count) * WIDTH).astype(np.int32)
            win = pa.Array.from_buffers(pa.binary(), len(sort), [None, pa.py_buffer(cuts), pa.py_buffer(x)])
            yield pa.record_batch([pa.array(sort, pa.int32()), win], ["sort", "win"])

    return documents(df, "text").mapInArrow(run, "sort int, win binary")


def learn(df: DataFrame) -> Network | None:
    """Train on the labelled findings of all documents; None if a label has fewer than 8 or none on either side of the hold-out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(packed(findings(df).distinct().repartition(parts, "win").withColumn("held", F.pmod(F.xxhash64("win"), F.lit(3)) == 0)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, sort in zip(batch.column("held").to_pylist(), batch.column("sort").to_pylist(), strict=True):
                kinds, n = np.unique(np.frombuffer(sort, np.int8), return_counts=True)
                yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array([held] * len(n)), pa.array(n, pa.int64())], ["sort", "held", "n"])

    each = found.mapInArrow(tally, "sort int, held boolean, n long").groupBy("sort", "held").agg(F.sum("n").alias("n")).collect()  # 10 rows at most
    counts = {(r["sort"] >= 0, r["sort"], r["held"]): r["n"] for r in each}
    size = lambda **want: sum(n for (y, _, held), n in counts.items() if want.items() <= {"y": y, "held": held}.items())
    if min(size(y=y) for y in (True, False)) < 8 or not all(size(y=y, held=h) for y in (True, False) for h in (True, False)):
        return None
    sides = Counter(y for y, _, held in counts if not held)
    weight = {sort: 0.5 / sides[y] / n for (y, sort, held), n in counts.items() if not held}
    return settled(train(found.where("not held"), weight), found.where("held"))


Span = tuple[int, int, int, float]


def all_spans(texts: pa.Array | list[str | None], net: Network | None) -> list[list[Span]]:
    """(start, kind, end, probability) of each text, sorted: base spans, whatever the network says of them, and the candidates beside them that it accepts.

    A token's probability is the largest of its windows'.
    """
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    f = Found(texts)
    row, start, kind, end, p = f.row, f.start, f.kind, f.end, np.zeros(len(f.row))
    if net is not None and len(row) + f.beside.sum():
        r, s, e = f.candidates[f.beside].T
        row, start, end, token = (np.concatenate(q) for q in ((row, r), (start, s), (end, e), (f.token, s)))
        kind = np.concatenate([kind, np.full(len(r), 3)])
        x, count = f.windows(row, token, token, end)
        z = np.maximum.reduceat(net.odds(*net.best(x)), np.cumsum(count) - count)
        p = net.probability(z)
        keep = np.flatnonzero((kind < 3) | (z >= net.threshold))
        keep = keep[np.lexsort((end[keep], kind[keep], start[keep]))]
        row, start, kind, end, p = (v[keep] for v in (row, start, kind, end, p))
    first = f.edges[row]
    every = list(zip((start - first).tolist(), kind.tolist(), (end - first).tolist(), p.tolist(), strict=True))
    cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    return [every[a:b] for a, b in zip(cuts, cuts[1:])]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(df: DataFrame) -> DataFrame:
    """The contract of op9: doc_id, n_assign, n_access, n_hex, base_sha256, spans; and scores, the network's probability of each span in thousandths."""
    net = learn(df)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            found = all_spans(part.column("text"), net)
            count = lambda k: pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())
            base = [hashlib.sha256(shown([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.record_batch([part.column("doc_id"), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array([shown(f) for f in found], pa.string()), pa.array([",".join(str(round(1000 * x[3])) for x in f) for f in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string")


def redact(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns of the documents, with every span of every text replaced by `mark`."""
    net = learn(df)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            found, texts = all_spans(part.column("text"), net), part.column("text").to_pylist()
            for i, spans in enumerate(found):
                out, done = [], 0
                for start, _, end, _ in spans:
                    if end > done:
                        out += [texts[i][done : max(start, done)]] + ([mark] if start >= done else [])
                        done = end
                if spans:
                    texts[i] = "".join(out) + texts[i][done:]
            columns = list(part.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, part.schema.names)

    return df.mapInArrow(run, df.schema)
