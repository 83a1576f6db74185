"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One edit changes the letter counts of a word by an L1 distance of two at most:
a replaced letter is one count more and one less, an inserted letter one more.
So the near words of a word lie in a small box around its vector, in the tree of its own
length and in the tree of the next one; the second search serves both words.

The upper part of each length's tree is fitted to a bounded sample of words and
cut where a leaf holds about `LEAF` words. It deals the words to tasks: a word goes to its
own leaf, and as a query to the leaves that its box meets. A leaf that no
letter divides further (anagrams) is dealt in parts by the words' hash, and
queries go to all parts. In a task the rest of the tree stands over the leaf's
distinct vectors, with the least box of each node; a box that a query can't reach with
its edit is pruned. Pairs of vectors at the right distance give pairs of words, whose order of letters is
verified: half of the shorter word must agree at the front or at the back, and then
everything but one letter.

Words are counted by slices first, then over all; the forms' chains are followed
by joins, in as many rounds as counts that fall tenfold with each step allow.

What is decided by hash: equal runs within one slice of texts (64 bits).

Defined results: null and empty texts have no words; a null id stands for '' in the
hash of a run; repeated rows count each, with the same letters deleted; runs of any
length are taken whole; ties between forms go to the smaller word; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import column_bytes, slices, span_hashes, written

#: Letters of a word, and occurrences, at least; a form's occurrences for each of the word's, at least; the share of runs that lose a letter.
LETTERS, TIMES, FACTOR, SHARE = 7, 2, 10, 31
#: Words of a leaf that is one task's, words of the sample that the upper trees are fitted to, and their depth at most.
LEAF, SAMPLE, DEPTH = 20_000, 50_000, 12
#: Vectors of a leaf inside a task.
INNER = 128
#: Letters: a to z, then the code points from 0xC0 to 0xFF.
DIMS = 26 + 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = 0xEDB88320 ^ (_c >> 1) if _c & 1 else _c >> 1
    _CRC[_i] = _c


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span after the text whose crc32 is `before`, a byte of all spans at a time; long spans one by one."""
    out, size = before.copy(), ends - starts
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    at = np.flatnonzero(size <= 64)
    at = at[np.argsort(-size[at], kind="stable")]
    state = ~out[at]
    live = np.searchsorted(-size[at], -np.arange(65), "left")  # spans of more than k bytes stand in front
    for k in range(64):
        m = live[k]
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ data[starts[at[:m]] + k]) & 255] ^ (state[:m] >> 8)
    out[at] = ~state
    return out


def _runs(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Distinct runs of a slice after the deletions, and how often each occurs."""
    data, offsets = column_bytes(part.column("text"))
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    letters = ends - starts - (leads[ends] - leads[starts])
    keep = letters >= LETTERS
    starts, ends, letters = starts[keep], ends[keep], letters[keep]
    data = _LOWER[data]
    row = np.searchsorted(offsets, starts, "right") - 1
    ids = np.array([zlib.crc32(f"{d}:".encode()) for d in part.column("doc_id").to_pylist()], np.uint32)
    h = _crcs(data, starts, ends, ids[row])
    cut = h % SHARE == 0
    changed = []
    for s, e, at in zip(starts[cut], ends[cut], h[cut] % letters[cut]):
        w = data[s:e].tobytes().decode()
        if len(w) > LETTERS:
            changed.append(w[:at] + w[at + 1 :])
    starts, ends = starts[~cut], ends[~cut]
    _, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
    s, size = starts[first], ends[first] - starts[first]
    to = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.arange(to[-1]) + np.repeat(s - to[:-1], size)]
    whole = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
    return pa.concat_arrays([whole, pa.array(changed, pa.string())]), np.append(n, np.ones(len(changed), np.int64))


def vocabulary(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n: the words of whole texts that occur `times` times at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, n = _runs(part)
            yield pa.record_batch([words, pa.array(n)], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _matrix(words: list[str], length: int) -> np.ndarray:
    """The words' letters, one byte each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts."""
    at = np.where(letters >= 0xC0, letters.astype(np.int64) - 0xC0 + 26, letters.astype(np.int64) - 97)
    rows = np.arange(len(letters))[:, None]
    return np.bincount((rows * DIMS + at).ravel(), minlength=len(letters) * DIMS).reshape(-1, DIMS)


def upper(v: np.ndarray, each: int, leaf: int = LEAF) -> tuple:
    """The upper tree of one length, from the sample's vectors, of which each stands for `each` words.

    A node is (letter, count, left, right): at most that count goes left. A leaf is (number, parts).
    """
    leaves = 0

    def grow(v: np.ndarray, depth: int) -> tuple:
        nonlocal leaves
        most = len(v) * each
        if most > leaf and depth < DEPTH:
            for d in np.argsort(-v.var(0), kind="stable")[:8]:
                t = int(np.median(v[:, d]))
                t -= t == v[:, d].max()
                left = v[:, d] <= t
                if left.any() and not left.all():
                    return int(d), t, grow(v[left], depth + 1), grow(v[~left], depth + 1)
        leaves += 1
        return leaves - 1, -(-most // leaf) if most > leaf else 1

    return grow(v, 0)


def _own(tree: tuple, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's leaf, and the leaf's parts."""
    leaf, parts = np.zeros(len(v), np.int64), np.ones(len(v), np.int64)
    todo = [(tree, np.arange(len(v)))]
    while todo:
        node, at = todo.pop()
        if len(node) == 2:
            leaf[at], parts[at] = node
        elif len(at):
            left = v[at, node[0]] <= node[1]
            todo += [(node[2], at[left]), (node[3], at[~left])]
    return leaf, parts


def _met(tree: tuple, v: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each leaf: the vectors that reach its box by counting at most `more` letters up and `less` down."""
    todo = [(tree, np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), {}, {})]
    while todo:
        node, at, up, down, low, high = todo.pop()
        if not len(at):
            continue
        if len(node) == 2:
            yield at, *node
            continue
        d, t, left, right = node
        x = v[at, d]
        step = np.maximum(x - t, 0) - (np.maximum(x - high[d], 0) if d in high else 0)
        ok = down + step <= less
        todo.append((left, at[ok], up[ok], (down + step)[ok], low, high | {d: t}))
        step = np.maximum(t + 1 - x, 0) - (np.maximum(low[d] - x, 0) if d in low else 0)
        ok = up + step <= more
        todo.append((right, at[ok], (up + step)[ok], down[ok], low | {d: t + 1}, high))


class Inner:
    """The tree over the distinct vectors of one leaf."""

    def __init__(self, words: list[str], n: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
        self.letters = _matrix(self.words, len(words[0]))
        self.v, back, size = np.unique(vectors(self.letters), axis=0, return_inverse=True, return_counts=True)
        self.members = np.argsort(back.ravel(), kind="stable")  # words by vector
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.order = np.arange(len(self.v))
        self.kind = np.float32 if len(words[0]) < 1000 else np.float64  # whole numbers stay exact
        self.root = self._grow(0, len(self.v))

    def _grow(self, a: int, b: int) -> tuple:
        own = self.v[self.order[a:b]]
        low, high = own.min(0), own.max(0)
        wide = high - low
        if b - a <= INNER or not wide.any():
            return low, high, a, b
        d = int(own.var(0).argmax())
        by = np.argsort(own[:, d], kind="stable")
        self.order[a:b] = self.order[a:b][by]
        values = own[by, d]
        cut = np.searchsorted(values, values[len(values) // 2], "left")
        cut = cut if cut else np.searchsorted(values, values[0], "right")
        return low, high, a, b, self._grow(a, a + int(cut)), self._grow(a + int(cut), b)

    def pairs(self, q: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(query vector, own vector) pairs that differ by `more` letters up and `less` down, counted from the query."""
        got, q_norm, v_norm = [], (q * q).sum(1), (self.v * self.v).sum(1)
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            low, high, a, b = node[:4]
            up = np.maximum(low - q[at], 0).sum(1)
            down = np.maximum(q[at] - high, 0).sum(1)
            at = at[(up <= more) & (down <= less)]
            if not len(at):
                continue
            if len(node) > 4:
                todo += [(node[4], at), (node[5], at)]
                continue
            own = self.order[a:b]
            for i in range(0, len(at), 1 << 14):
                each = at[i : i + (1 << 14)]
                dot = q[each].astype(self.kind) @ self.v[own].astype(self.kind).T
                # with sums that differ by more - less, a squared distance of more + less leaves single steps only
                x, y = np.nonzero(2 * dot == (q_norm[each][:, None] + v_norm[own][None, :] - more - less))
                got.append((each[x], own[y]))
        return tuple(np.concatenate(z) for z in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, words: list[str], longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, own word) that are one edit apart; `longer`: own words have one letter more."""
        length = len(words[0])
        letters = _matrix(words, length)
        v, back, size = np.unique(vectors(letters), axis=0, return_inverse=True, return_counts=True)
        members, first = np.argsort(back.ravel(), kind="stable"), np.concatenate(([0], np.cumsum(size)))
        x, y = self.pairs(v, 1, 0 if longer else 1)
        many = size[x] * np.diff(self.first)[y]
        k = min(8, length // 2)
        ends = lambda m: (_number(m[:, :k]), _number(m[:, m.shape[1] - k :]))
        (head, tail), (own_head, own_tail) = ends(letters), ends(self.letters)
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(many[at : at + (1 << 21)]), 1 << 21, "right")) + at)
            n = many[at:stop]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(np.diff(self.first)[y[at:stop]], n)
            i = members[np.repeat(first[x[at:stop]], n) + inside // width]
            j = self.members[np.repeat(self.first[y[at:stop]], n) + inside % width]
            ok = (head[i] == own_head[j]) | (tail[i] == own_tail[j])
            i, j = i[ok], j[ok]
            most = max(1, (32 << 20) // length)
            for s in range(0, len(i), most):
                a, b = letters[i[s : s + most]], self.letters[j[s : s + most]]
                if longer:
                    same, back_same = a == b[:, :length], (a == b[:, 1:])[:, ::-1]
                    run = lambda m: np.where(m.all(1), length, m.argmin(1))
                    ok = run(same) + run(back_same) >= length
                else:
                    ok = (a != b).sum(1) == 1
                yield i[s : s + most][ok], j[s : s + most][ok]
            at = stop


def _number(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), 8), np.uint8)
    out[:, : m.shape[1]] = m
    return out.view(np.uint64).ravel()


def _best(i: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs, by i: how many, and the one of largest n, then smallest rank."""
    order = np.lexsort((rank, -n, i))
    first = np.flatnonzero(np.diff(i[order], prepend=-1))
    return i[order][first], np.diff(np.append(first, len(i))), order[first]


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word, n_near, best_n, best: how many words (word, n) are one edit apart, and the most frequent of them. Words without any are left out."""
    sized = words.withColumn("length", F.length("word"))
    large = {r["length"]: r["count"] for r in sized.groupBy("length").count().where(F.col("count") > leaf).collect()}  # a row for `leaf` words at least
    each = max(1, sum(large.values()) // SAMPLE)
    trees = {}
    if large:
        some = sized.where(F.col("length").isin(*large) & (F.pmod(F.xxhash64("word"), F.lit(each)) == 0)).select("word").collect()
        by: dict[int, list[str]] = {}
        for r in some:
            by.setdefault(len(r["word"]), []).append(r["word"])
        trees = {n: upper(vectors(_matrix(ws, n)), each, leaf) for n, ws in by.items()}
    single = (0, 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            size = np.array([len(w) for w in text], np.int64)
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                v = vectors(_matrix([text[i] for i in rows], length))
                hashed = np.array([zlib.crc32(text[i].encode()) for i in rows], np.int64)
                own, parts = _own(trees.get(length, single), v)
                out = [(rows, length, own, hashed % parts, 0)]
                for role, at_length, more, less in ((1, length, 1, 1), (2, length + 1, 1, 0)):
                    for at, number, k in _met(trees.get(at_length, single), v, more, less):
                        out += [(rows[at], at_length, np.full(len(at), number), np.full(len(at), p), role) for p in range(k)]
                for at, at_length, number, part, role in out:
                    columns = [pa.array(np.full(len(at), at_length), pa.int32()), pa.array(number, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(at), role), pa.int32()), b.column("word").take(pa.array(at)), pa.array(n[at])]
                    yield pa.record_batch(columns, ["length", "leaf", "part", "role", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words_in, n_in, tree = None, [], [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_numpy().tolist() for c in ("length", "leaf", "part", "role"))))
            text, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            a = 0
            while a < len(keys):
                z = a + 1
                while z < len(keys) and keys[z] == keys[a]:
                    z += 1
                *key, role = keys[a]
                if key != now:
                    now, words_in, n_in, tree = key, [], [], None
                if role == 0:
                    words_in += text[a:z]
                    n_in += n[a:z].tolist()
                elif words_in:
                    tree = tree or Inner(words_in, n_in)
                    yield from _found(tree, text[a:z], n[a:z], role == 2)
                a = z

    kind = "length int, leaf int, part int, role int, word string, n long"
    count = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["length", "leaf", "part"]
    found = words.mapInArrow(deal, kind).repartition(count, *keys).sortWithinPartitions(*keys, "role").mapInArrow(search, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def _found(tree: Inner, words: list[str], n: np.ndarray, longer: bool) -> Iterator[pa.RecordBatch]:
    """What the pairs say about the queries and, where own words are longer, about those too."""
    rank = np.argsort(np.argsort(np.array(words, object), kind="stable"), kind="stable")
    for i, j in tree.near(words, longer):
        if len(i):
            at, many, best = _best(i, tree.n[j], j)
            yield _row([words[k] for k in at], many, tree.n[j[best]], [tree.words[k] for k in j[best]])
            if longer:
                at, many, best = _best(j, n[i], rank[i])
                yield _row([tree.words[k] for k in at], many, n[i[best]], [words[k] for k in i[best]])


def _row(word: list[str], many: np.ndarray, n: np.ndarray, best: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(word, pa.string()), pa.array(many, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], ["word", "n_near", "best_n", "best"])


def variants(docs: DataFrame, times: int = TIMES, factor: int = FACTOR) -> DataFrame:
    """The contract of op12: word, form, root, n, n_near, form_n."""
    if factor < 2:
        raise ValueError("forms must be twice as frequent at least, else their chains needn't end")
    words = written(vocabulary(docs, times))
    near = near_words(words)
    told = words.join(near, "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    told = written(told.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    most = told.agg(F.max("n")).first()[0] or 1
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log(most, factor) + 1)))):  # each round doubles the steps
        links = written(links.alias("a").join(links.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root")))
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
