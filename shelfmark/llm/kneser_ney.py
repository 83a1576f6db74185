"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays that workers map into memory.

Level 1 is the sorted array of the words' 64-bit hashes; a word's rank is its
place there. Level n is a sorted array of (rank of the first n - 1 words on
level n - 1, rank of the last word). Every level is cut into shards, one pair of
files each, in the folder that the executors share: level 1 by hash, the others by a
hash of the context, and of the last word for contexts that are so frequent that
one shard shouldn't hold them. What travels between tasks are counts of a slice
of texts, sorted and packed, one binary for each shard; nothing is gathered
on the driver but a row for each shard.

The top level has raw counts. A lower one has the number of distinct words that
stand before its n-gram, or the raw count where only the start of a text stands
there. With v the value of an n-gram and D the discount of its level for values of
1, 2, and 3 or more (from the counts of counts; 0.5, 1, 1.5 where one of those is
zero; kept within 0 and the value): p(w | context) = max(v - D, 0) / total + rest * p(w | shorter context), rest = (D1 n1 + D2 n2 + D3 n3) / total.
Level 1 is interpolated with 1 / (V + 1), which is also what unknown words get.
Contexts that training doesn't hold leave the shorter context's probability.
A text begins after one start mark, which is no token and is never predicted; the end
mark is a token.

What is decided by hash: equal words (64 bits). Word and context ranks must fit
together into 63 bits; an error says so where they don't.

Defined results: a null or empty text is the end mark alone; repeated rows count
and score once each; a null id counts as the id '' for the fold; without training texts N
and V are 0 and every token has probability 1; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import column_bytes, documents, fold, mix, scratch, signed, slices, span_hashes, word_spans, written
from shelfmark.llm.arrays import load, pack, save, unpack, where

ORDER = 2
#: Bytes of training text for each shard of level 1 and of the others.
WORD_SHARD, SHARD = 64 << 20, 16 << 20
#: A context of more occurrences than this is spread over all shards of its level.
HOT = 100_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Strings with a space are no words.
END, START = (int(signed(span_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)])))[0]) for s in (b" end", b" start"))


@dataclass(frozen=True)
class Level:
    """Where each shard's ranks begin, one more than there are shards; the level's discounts once they are known."""

    n: int
    base: tuple[int, ...]
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)

    @property
    def shards(self) -> int:
        return len(self.base) - 1

    @property
    def size(self) -> int:
        return self.base[-1]


@dataclass(frozen=True)
class Model:
    """A trained model; its arrays lie in `folder`."""

    folder: str
    order: int
    levels: tuple[Level, ...]
    train_tokens: int = 0
    words: int = 0
    #: Of level 1: the sum of values, and what its discounts leave for 1 / (V + 1).
    total: int = 0
    rest: float = 1.0
    start: int = field(default=-1)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a slice, with the end mark after each text, and each text's range."""
    data, offsets = column_bytes(part.column("text"))
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    rows = part.num_rows
    bounds = first + np.arange(rows + 1)
    out = np.full(bounds[-1], END, np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(first))] = signed(span_hashes(data, starts, ends))
    return out, bounds


def _cut(top: np.ndarray, shards: int) -> np.ndarray:
    return (mix(top.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Reader:
    """The arrays of a model as a worker sees them."""

    def __init__(self, model: Model):
        self.m = model

    def _array(self, n: int, shard: int, what: str) -> np.ndarray:
        return load(self.m.folder, f"{n}-{shard}-{what}")

    def words(self, h: np.ndarray) -> np.ndarray:
        """Ranks of hashes in ascending order; -1 where unknown."""
        level = self.m.levels[0]
        out = np.full(len(h), -1, np.int64)
        step = 1 << (64 - (level.shards - 1).bit_length()) if level.shards > 1 else 1 << 64
        edges = np.searchsorted(h, np.array([-(1 << 63) + i * step for i in range(1, level.shards)], np.int64))
        for s, (a, b) in enumerate(zip([0, *edges], [*edges, len(h)])):
            if a < b:
                at, ok = where(self._array(1, s, "keys"), h[a:b])
                out[a:b][ok] = level.base[s] + at[ok]
        return out

    def shard(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        raw = self.gather(n - 1, context, "raw")[0]
        return _cut(np.where(raw >= HOT, word, context), self.m.levels[n - 1].shards)

    def gather(self, n: int, ranks: np.ndarray, *what: str) -> list[np.ndarray]:
        """Values at ranks of level n; 0 for rank -1."""
        base = np.array(self.m.levels[n - 1].base)
        u, back = np.unique(ranks, return_inverse=True)
        out = [np.zeros(len(u), np.int64) for _ in what]
        cut = np.searchsorted(u, base)
        for s in range(len(base) - 1):
            if cut[s] < cut[s + 1]:
                for o, w in zip(out, what):
                    o[cut[s] : cut[s + 1]] = self._array(n, s, w)[u[cut[s] : cut[s + 1]] - base[s]]
        return [o[back] for o in out]

    def find(self, n: int, context: np.ndarray, word: np.ndarray, what: str | None) -> np.ndarray:
        """Of n-grams (context and word known): their value, 0 where there is none; without `what` their rank, -1 where there is none."""
        level, width = self.m.levels[n - 1], self.m.levels[0].size
        u, back = np.unique(context * width + word, return_inverse=True)
        c, w = np.divmod(u, width)
        shard = self.shard(n, c, w)
        out = np.full(len(u), 0 if what else -1, np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(level.shards + 1))
        for s in range(level.shards):
            at = order[cut[s] : cut[s + 1]]
            if len(at):
                place, ok = where(self._array(n, s, "keys"), u[at])
                out[at[ok]] = self._array(n, s, what)[place[ok]] if what else level.base[s] + place[ok]
        return out[back]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        u, back = np.unique(h, return_inverse=True)
        return self.words(u)[back]

    def contexts(self, r: np.ndarray, bounds: np.ndarray, most: int) -> list[np.ndarray]:
        """For n = 1 ... most the rank on level n of the n words before each token; -1 where there is none. The start mark counts as one word."""
        before = lambda x, fill: _before(x, bounds, fill)
        out = [before(r, self.m.start)]
        for n in range(2, most + 1):
            last, known = out[-1], np.full(len(r), -1, np.int64)
            ok = (last >= 0) & (r >= 0)
            known[ok] = self.find(n, last[ok], r[ok], None)
            out.append(before(known, -1))
        return out


def _before(x: np.ndarray, bounds: np.ndarray, fill: int) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[bounds[:-1]] = fill
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each shard, from rows sorted by shard."""
    now, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if rows and row["shard"] != now:
                yield now, rows
                rows = []
            now = row["shard"]
            rows.append(row)
    if rows:
        yield now, rows


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


REPORT = "shard int, kind int, size long, blob binary"


def _report(rows: list[tuple]) -> pa.RecordBatch:
    shard, kind, size, blob = zip(*rows)
    return pa.record_batch([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], ["shard", "kind", "size", "blob"])


def _of_counts(v: np.ndarray) -> bytes:
    """How often the values 1 to 4 stand there, how many there are, and their sum."""
    return np.array([*(np.count_nonzero(v == i) for i in range(1, 5)), np.count_nonzero(v), v.sum()], np.int64).tobytes()


def _told(level_below: Level, keys: np.ndarray, suffix: np.ndarray, v: np.ndarray, width: int) -> Iterator[tuple]:
    """What a shard's n-grams say about the level below: each context's totals, and how many n-grams end in each shorter one. A row for each shard below."""
    base = np.array(level_below.base)

    def dealt(kind: int, ranks: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        cut = np.searchsorted(ranks, base)
        for s in range(len(base) - 1):
            a, b = cut[s], cut[s + 1]
            if a < b:
                yield s, kind, 0, pack(ranks[a:b] - base[s], *(c[a:b] for c in columns))

    context = keys // width
    first = np.flatnonzero(np.diff(context, prepend=-1))
    total = lambda x: np.add.reduceat(x.astype(np.int64), first)
    yield from dealt(1, context[first], total(v), total(v == 1), total(v == 2), total(v >= 3))
    yield from dealt(2, *np.unique(suffix, return_counts=True))


def _word_level(texts: DataFrame, folder: str, shards: int) -> DataFrame:
    """Level 1: (shard, size, raw count of all but the start mark, of the start mark) of each shard written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, n = np.unique(tokens(part)[0], return_counts=True)
            yield pa.record_batch([pa.array(np.append(h, START)), pa.array(np.append(n, part.num_rows))], ["h", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            keys, raw = t["h"].to_numpy(), t["n"].to_numpy()
            save(folder, f"1-{shard}-keys", keys)
            save(folder, f"1-{shard}-raw", _small(raw))
            start = int(raw[keys == START].sum())
            return pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(keys), int(raw.sum()) - start, start))], ["shard", "size", "n", "texts"])

        now, parts = None, []
        for b in batches:
            s = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for a, z in zip(cuts, cuts[1:]):
                if parts and s[a] != now:
                    yield flush(now, parts)
                    parts = []
                now = int(s[a])
                parts.append(b.slice(a, z - a))
        if parts:
            yield flush(now, parts)

    bits = (shards - 1).bit_length()
    shard = (F.shiftright("h", 64 - bits) + shards // 2) if bits else F.lit(0)
    counted = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).withColumn("shard", shard.cast("int"))
    return counted.repartition(shards, "shard").sortWithinPartitions("shard", "h").mapInArrow(write, "shard int, size long, n long, texts long")


def _level(texts: DataFrame, model: Model, n: int, shards: int) -> DataFrame:
    """Level n, written; `REPORT` rows. `model` has the levels below, and a level n of the right number of shards."""
    width, top = model.levels[0].size, n == model.order
    columns = 2 if n == 2 else 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(model)
        for part in slices(batches):
            h, bounds = tokens(part)
            rank = r.ranks(h)
            contexts = r.contexts(rank, bounds, n - 1)
            ok = np.flatnonzero(contexts[-1] >= 0)
            key, first, many = np.unique(contexts[-1][ok] * width + rank[ok], return_index=True, return_counts=True)
            c, w = np.divmod(key, width)
            each = [key, many]
            if n > 2:
                at = ok[first]
                each.append(r.find(n - 1, contexts[-2][at], rank[at], None))
            shard = r.shard(n, c, w)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            there = [s for s in range(shards) if cut[s] < cut[s + 1]]
            yield pa.record_batch([pa.array(there, pa.int32()), pa.array([pack(*(x[order[cut[s] : cut[s + 1]]] for x in each)) for s in there], pa.binary())], ["shard", "blob"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _blocks(batches):
            parts = [unpack(x["blob"], columns) for x in rows]
            key, many, *more = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            keys, raw = key[order][first], np.add.reduceat(many[order], first)
            suffix = more[0][order][first] if more else keys % width
            save(folder, f"{n}-{shard}-keys", keys)
            save(folder, f"{n}-{shard}-raw", _small(raw))
            if more and not top:
                save(folder, f"{n}-{shard}-suffix", suffix)
            told = _told(model.levels[n - 2], keys, suffix, raw, width) if top else (x for x in _told(model.levels[n - 2], keys, suffix, raw, width) if x[1] == 2)
            yield _report([(shard, 0, len(keys), _of_counts(raw)), *told])

    folder = model.folder
    return texts.mapInArrow(count, "shard int, blob binary").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, REPORT)


def _values(told: DataFrame, model: Model, n: int) -> DataFrame:
    """Values and totals of level n, from what level n + 1 says; `REPORT` rows for the level below."""
    level, width, folder = model.levels[n - 1], model.levels[0].size, model.folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _blocks(batches):
            size = level.base[shard + 1] - level.base[shard]
            sums = {w: np.zeros(size, np.int64) for w in ("value", "total", "n1", "n2", "n3")}
            for row in rows:
                names = ("total", "n1", "n2", "n3") if row["kind"] == 1 else ("value",)
                at, *each = unpack(row["blob"], len(names) + 1)
                for name, x in zip(names, each):
                    sums[name][at] += x
            if n > 1:
                keys = load(folder, f"{n}-{shard}-keys")
                sums["value"] = np.where(sums["value"] == 0, load(folder, f"{n}-{shard}-raw"), sums["value"])  # nothing but the start of a text before them
            for name, x in sums.items():
                save(folder, f"{n}-{shard}-{name}", _small(x))
            out = [(shard, 0, size, _of_counts(sums["value"]))]
            if n > 1:
                suffix = load(folder, f"{n}-{shard}-suffix") if n > 2 else keys % width
                out += [x for x in _told(model.levels[n - 2], np.asarray(keys), np.asarray(suffix), sums["value"], width) if x[1] == 1]
            yield _report(out)

    return told.where("kind > 0").select("shard", "kind", "blob").repartition(level.shards, "shard").sortWithinPartitions("shard").mapInArrow(write, REPORT)


def _discounts(v: np.ndarray) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (int(x) for x in v[:4])
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _summed(report: DataFrame) -> tuple[dict[int, int], np.ndarray]:
    """Each shard's size and the counts of counts: a row for each shard comes to the driver."""
    rows = report.where("kind = 0").select("shard", "size", "blob").collect()
    return {r["shard"]: r["size"] for r in rows}, sum((np.frombuffer(r["blob"], np.int64) for r in rows), np.zeros(6, np.int64))


def _base(sizes: dict[int, int], shards: int) -> tuple[int, ...]:
    return (0, *np.cumsum([sizes.get(s, 0) for s in range(shards)]).tolist())


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """A model of all rows of `texts` (column text). Each level is one pass over the texts."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    texts = documents(texts, "text")
    folder = scratch(texts.sparkSession)
    weight = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, int(weight // WORD_SHARD)).bit_length()
    told = _word_level(texts, folder, shards).collect()  # a row for each shard
    base = _base({r["shard"]: r["size"] for r in told}, shards)
    if not base[-1]:
        return Model(folder, order, ())
    for s in set(range(shards)) - {r["shard"] for r in told}:
        for what in ("keys", "raw"):
            save(folder, f"1-{s}-{what}", np.zeros(0, np.int64))
    model = Model(folder, order, (Level(1, base),), sum(r["n"] for r in told), base[-1] - 1)
    model = _with(model, start=int(Reader(model).words(np.array([START], np.int64))[0]))
    shards = max(1, int(weight // SHARD))
    reports = []
    for n in range(2, order + 1):
        if model.levels[-1].size * base[-1] >= 1 << 63:
            raise ValueError(f"level {n} has more keys than 63 bits hold")
        model = _with(model, levels=(*model.levels, Level(n, (0,) * (shards + 1))))
        report = written(_level(texts, model, n, shards))
        sizes, counts = _summed(report)
        for s in set(range(shards)) - set(sizes):
            for what in ("keys", "raw"):
                save(folder, f"{n}-{s}-{what}", np.zeros(0, np.int64))
        model = _with(model, levels=(*model.levels[:-1], Level(n, _base(sizes, shards), _discounts(counts))))
        reports.append(report)
    told = reports[-1]
    for n in range(order - 1, 0, -1):
        level = model.levels[n - 1]
        done = written(_values(told, model, n))
        sizes, counts = _summed(done)
        for s in set(range(level.shards)) - set(sizes):
            for what in ("value", "total", "n1", "n2", "n3"):
                save(folder, f"{n}-{s}-{what}", np.zeros(level.base[s + 1] - level.base[s], np.int64))
        d = _discounts(counts)
        levels = (*model.levels[: n - 1], Level(n, level.base, d), *model.levels[n:])
        model = _with(model, levels=levels)
        told = done.where("kind = 1").unionByName(reports[n - 2].where("kind = 2")) if n > 1 else None
    n1, n2, _, _, types, total = (int(x) for x in counts)
    return _with(model, total=total, rest=(d[0] * n1 + d[1] * n2 + d[2] * (types - n1 - n2)) / total)


def _with(model: Model, **changed) -> Model:
    return Model(**({k: getattr(model, k) for k in model.__dataclass_fields__} | changed))


def _discounted(v: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(v - np.array([0.0, *d])[np.minimum(v, 3)], 0.0)


def _log10(model: Model, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each token's probability in the model, of its add-one share, and whether it is known."""
    if not model.levels:
        return np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h), bool)
    r = Reader(model)
    rank = r.ranks(h)
    raw, value = r.gather(1, rank, "raw", "value")
    base = np.log10((raw + 1) / (model.train_tokens + model.words + 1))
    p = _discounted(value, model.levels[0].discounts) / model.total + model.rest / (model.words + 1)
    for n, context in enumerate(r.contexts(rank, bounds, model.order - 1), 2):
        d = model.levels[n - 1].discounts
        total, n1, n2, n3 = r.gather(n - 1, context, "total", "n1", "n2", "n3")
        v = np.zeros(len(h), np.int64)
        ok = (context >= 0) & (rank >= 0)
        v[ok] = r.find(n, context[ok], rank[ok], "raw" if n == model.order else "value")
        some = total > 0
        t = np.where(some, total, 1)
        p = np.where(some, _discounted(v, d) / t + (d[0] * n1 + d[1] * n2 + d[2] * n3) / t * p, p)
    return np.log10(p), base, raw > 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every whole text; scores are log10, with six decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, bounds = tokens(part)
            p, base, known = _log10(model, h, bounds)
            add = lambda x: np.add.reduceat(x, bounds[:-1])
            n, total = np.diff(bounds), add(p)
            columns = [n, add(known.astype(np.int64)), np.round(add(base), 6), np.round(total, 6), 10.0 ** (-total / n)]
            yield pa.record_batch([part.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id, 7) == 2


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The contract of op11: the model learns from the documents that aren't held out and scores all."""
    model = train(docs.where(~held_out()), order)
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
