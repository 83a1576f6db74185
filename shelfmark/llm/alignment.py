"""Two tokenizers' tokens of one text, aligned by bytes; each distinct text once.

Texts are shuffled by the full text, so that copies meet and count as a number.
Each distinct text is encoded by both tokenizers and cut at the bytes where tokens of both
end. Between two neighbouring ends of either side lies one link, the pair of
tokens that overlap there. A text keeps its distinct id pairs with their counts; over all texts,
weighted by copies, these sum to the corpus's counts of pairs, which are written as
sorted arrays in the shared folder, by B id. Workers map them to measure each distinct
text, and the measures are joined to the documents by the text's SHA-256.

Nothing grows with a group of copies: they are one row from the first partial
aggregate on, and the last join has one row for each text on its right side.

Defined results: null and empty texts, and texts whose tokens don't join to the
space and the text, have no tokens: zeros and ''; such texts add no pairs; strings of special tokens are plain
text; repeated rows are copies; extra columns are ignored; an empty table gives an
empty table. Equal texts are told by equal SHA-256 in the last join only.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import documents, scratch, slices, written
from shelfmark.llm.arrays import load, pack, save, unpack, where
from shelfmark.llm.bpe import byte_alphabet

#: Bytes of text at a time, and shards of the pairs' arrays.
SLICE, SHARDS = 1 << 20, 32
MEASURES = "n_a long, n_b long, n_groups long, n_links long"


class Side:
    """A tokenizer with the bytes of each of its ids."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, joined."""
        size = self.size[ids]
        to = np.cumsum(size)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.first[ids] - to + size, size)]


class ByteLevel(Side):
    """A byte-level vocabulary of the tokenizers library; encodes the text after a space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        names = {i: s for s, i in spec["model"]["vocab"].items()}
        super().__init__([b"" if names.get(i, "") in special else bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A vocabulary of sentencepiece, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        spell = lambda i: bytes([int(self.own.id_to_piece(i)[3:5], 16)]) if self.own.is_byte(i) else self.own.id_to_piece(i).replace("▁", " ").encode()
        super().__init__([spell(i) for i in range(self.own.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@lru_cache(2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    """Once for each Python worker."""
    return ByteLevel(a_path), Pieces(b_path)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n


def _whole(side: Side, ids: np.ndarray, n: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts the tokens give back byte for byte. `want`: the texts' bytes, `size` each."""
    row = np.repeat(np.arange(len(n)), n)
    ok = np.bincount(row, side.size[ids], len(n)).astype(np.int64) == size
    byte_row = np.repeat(np.arange(len(n)), size)
    wrong = side.joined(ids[ok[row]]) != want[ok[byte_row]]
    ok[byte_row[ok[byte_row]][wrong]] = False
    return ok


def _decimal(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in decimal, each after its mark (0: none), as bytes; and where each begins."""
    digits = np.ones(len(ids), np.int64)
    for k in range(1, 10):
        digits += ids >= 10**k
    size = digits + (mark > 0)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at[mark > 0]] = mark[mark > 0]
    last, left = at + size - 1, ids.copy()
    for k in range(int(digits.max(initial=0))):
        more = digits > k
        out[last[more] - k] = 48 + left[more] % 10
        left //= 10
    return out, at


def align(texts: list[str], a: Side, b: Side) -> tuple[np.ndarray, list[str], list[bytes]]:
    """For each text: (n_a, n_b, n_groups, n_links), SHA-256 of the groups, and its packed (b * |A| + a, count) pairs. No text is empty."""
    raw = [b" " + t.encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    want = np.frombuffer(b"".join(raw), np.uint8)
    (ia, na), (ib, nb) = _flat(a.encode(texts)), _flat(b.encode(texts))
    ok = _whole(a, ia, na, want, size) & _whole(b, ib, nb, want, size)
    ia, ib = ia[np.repeat(ok, na)], ib[np.repeat(ok, nb)]
    na, nb, size = np.where(ok, na, 0), np.where(ok, nb, 0), np.where(ok, size, 0)
    bounds = np.cumsum(size)
    ends = np.zeros(int(size.sum()) + 1, np.uint8)
    ends[np.cumsum(a.size[ia])] = 1
    ends[np.cumsum(b.size[ib])] |= 2
    cut = np.flatnonzero(ends)  # a link ends at each
    of_a, of_b = (ends[cut] & 1).astype(bool), (ends[cut] & 2).astype(bool)
    both = of_a & of_b
    at = lambda f: np.cumsum(f) - f  # noqa: E731  the token or group that a link is in
    row = np.searchsorted(bounds, cut, "left")
    group = at(both)
    key = ib[at(of_b)] * len(a.size) + ia[at(of_a)]
    count = lambda f: np.bincount(row[f], minlength=len(texts))
    numbers = np.stack([na, nb, count(both), count(slice(None))], 1)
    # groups as text: tokens by group, A before B
    ids, of = np.concatenate([ia, ib]), np.concatenate([2 * group[of_a], 2 * group[of_b] + 1])
    token_row = np.concatenate([row[of_a], row[of_b]])
    order = np.argsort(of, kind="stable")
    ids, of, token_row = ids[order], of[order], token_row[order]
    mark = np.where(np.diff(of, prepend=-1) == 0, ord(","), np.where(of & 1, ord("|"), ord(";"))).astype(np.uint8)
    mark[np.diff(token_row, prepend=-1) > 0] = 0
    out, begin = _decimal(ids, mark)
    edge = np.searchsorted(token_row, np.arange(len(texts) + 1))
    begin = np.append(begin, len(out))
    digests = [hashlib.sha256(out[begin[x] : begin[y]]).hexdigest() if x < y else "" for x, y in zip(edge, edge[1:])]
    # distinct pairs of each text
    width = len(a.size) * len(b.size)
    u, n = np.unique(row * width + key, return_counts=True)
    pair_row, u = np.divmod(u, width)
    edge = np.searchsorted(pair_row, np.arange(len(texts) + 1))
    return numbers, digests, [pack(u[x:y], n[x:y]) if x < y else b"" for x, y in zip(edge, edge[1:])]


def distinct_aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each distinct text that isn't empty: digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        for part in slices(batches, most=SLICE):
            texts = part.column("text").to_pylist()
            numbers, digests, pairs = align(texts, a, b)
            own = [hashlib.sha256(t.encode()).digest() for t in texts]
            columns = [pa.array(own, pa.binary()), part.column("copies"), *(pa.array(c) for c in numbers.T.astype(np.int64)), pa.array(digests), pa.array(pairs, pa.binary())]
            yield pa.record_batch(columns, ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    each = documents(docs, "text").where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return each.mapInArrow(run, f"digest binary, copies long, {MEASURES}, groups_sha256 string, pairs binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of all rows, and how many each row has."""
    each = [unpack(x, 2) if x else (np.zeros(0, np.int64),) * 2 for x in column.to_pylist()]
    return (*(np.concatenate(x) for x in zip(*each)), np.array([len(k) for k, _ in each], np.int64))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key, n: how many links of the corpus have each pair, copies included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "pairs", SLICE):
            key, n, rows = _pairs(part.column("pairs"))
            u, back = np.unique(key, return_inverse=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, back, n * np.repeat(part.column("copies").to_numpy(), rows))
            yield pa.record_batch([pa.array(u), pa.array(total)], ["key", "n"])

    return aligned.select("pairs", "copies").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _shelve(pairs: DataFrame, folder: str, width: int) -> None:
    """Write the pairs as sorted arrays, a shard for some B ids; `best` marks the largest counts of a B id. An id has `width` pairs at most, so a shard's size is bounded by the vocabularies."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def flush() -> None:
            t = pa.Table.from_batches(parts)
            key, n = t["key"].to_numpy(), t["n"].to_numpy()
            first = np.flatnonzero(np.diff(key // width, prepend=-1))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
            save(folder, f"{now}-keys", key)
            save(folder, f"{now}-n", n)
            save(folder, f"{now}-best", n == most)

        done = []
        for b in batches:
            s = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for x, y in zip(cuts, cuts[1:]):
                if parts and s[x] != now:
                    flush()
                    parts = []
                now = int(s[x])
                done.append(now)
                parts.append(b.slice(x, y - x))
        if parts:
            flush()
        yield pa.record_batch([pa.array(sorted(set(done)), pa.int32())], ["shard"])

    dealt = pairs.withColumn("shard", F.pmod(F.floor(F.col("key") / width), F.lit(SHARDS)).cast("int"))
    there = {r["shard"] for r in dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", "key").mapInArrow(write, "shard int").collect()}
    for s in set(range(SHARDS)) - there:
        for what, kind in (("keys", np.int64), ("n", np.int64), ("best", bool)):
            save(folder, f"{s}-{what}", np.zeros(0, kind))


def measured(aligned: DataFrame, folder: str, width: int) -> DataFrame:
    """digest, the numbers, n_best, count_sum and groups_sha256 of each distinct text."""
    names = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "pairs", SLICE):
            key, n, rows = _pairs(part.column("pairs"))
            u, back = np.unique(key, return_inverse=True)
            shard = u // width % SHARDS
            count, best = np.zeros(len(u), np.int64), np.zeros(len(u), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                place, _ = where(load(folder, f"{s}-keys"), u[at])
                count[at], best[at] = load(folder, f"{s}-n")[place], load(folder, f"{s}-best")[place]
            edge = np.concatenate(([0], np.cumsum(rows)))
            add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edge])
            columns = [*(part.column(c) for c in names), pa.array(add(n * best[back])), pa.array(add(n * count[back]))]
            yield pa.record_batch(columns, [*names, "n_best", "count_sum"])

    return aligned.select(*names, "pairs").mapInArrow(run, f"digest binary, {MEASURES}, groups_sha256 string, n_best long, count_sum long")


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The contract of op13: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f:
        width = max(json.load(f)["model"]["vocab"].values()) + 1
    once = written(distinct_aligned(docs, a_path, b_path))
    folder = scratch(spark)
    _shelve(pair_counts(once), folder, width)
    told = measured(once, folder, width)
    rows = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(told, "digest", "left").select("doc_id", *map(number, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
