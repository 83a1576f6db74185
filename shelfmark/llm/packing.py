"""Best-fit packing by pattern: enumerate, fit by non-negative least squares, round, pack residuals.

Documents become pieces of at most `capacity` tokens; only longer documents are
cut, and then the first piece is the short one. What decides the packing is
the histogram of piece lengths, which has `capacity` numbers whatever the size
of the corpus; it alone reaches the driver. There, patterns of a few pieces
that fill a sequence, or nearly so, are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and the
residual is packed by best fit decreasing, on counts. Pieces then find their
place by rank: the r-th piece of a length takes the r-th slot of that length.

Ranks are dealt in buckets of (length, hash), so that a frequent length is
spread over many tasks.

Defined results: a null or empty text is one piece that holds the end id only;
repeated rows are packed once each; columns other than doc_id and text are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm._text import documents, slices, written

CAPACITY = 1024
END = 2
#: Rows that one rank bucket of a length should hold.
BUCKET = 200_000
ROUNDS = 400
#: Pieces of a pattern at most, the share of it that may stay empty, and what an empty sequence costs in the fit.
PIECES, ROOM, SLACK = 8, 1 / 16, 0.05
SPECIAL = "<|endoftext|>"
#: White space runs of this many characters pass by the pattern's regex engine, whose stack ends at about a million.
RUN = 1 << 16
#: \s of the pattern (Unicode White_Space); Python's own has \x1c-\x1f too.
_run = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")


@lru_cache(2)
def tokenizer(ranks_path: str, pattern: str, special_id: int):
    """The byte-level vocabulary; its special token counts as such inside a text, as the tokenizers library has it."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special_id})


def encoded(text: str, tokens) -> np.ndarray:
    """The ids of a text. A very long white space run is cut out as the pattern does: one pre-token, of all but its last character where other text follows."""
    encode = lambda part: tokens.encode_to_numpy(part, allowed_special={SPECIAL})
    parts, done = [], 0
    for m in _run.finditer(text) if len(text) >= RUN else ():
        end = m.end() if m.end() == len(text) or text.startswith(SPECIAL, m.end()) else m.end() - 1
        parts += [encode(text[done : m.start()]), np.array(tokens._encode_single_piece(text[m.start() : end]), "<u4")]
        done = end
    return np.concatenate([*parts, encode(text[done:])]) if parts else encode(text)


def pieces(df: DataFrame, ranks_path: str, pattern: str, special_id: int = 50256, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(ranks_path, pattern, special_id)
        for part in slices(batches, most=1 << 20):
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.append(encoded(text, tokens), end) if text else [end]
                ids = np.asarray(ids, "<u4")
                a, b = 0, (len(ids) - 1) % capacity + 1
                while a < len(ids):
                    row.append(i)
                    number.append((a + capacity - 1) // capacity)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    a, b = b, b + capacity
            columns = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, capacity: int, most: int = PIECES) -> np.ndarray:
    """Ways to fill a sequence, but for a share of `ROOM`, with at most `most` pieces of lengths at hand, one a row, longest first; 0 is no piece.

    Every pair of lengths is filled up with the fewest pieces that come nearest to the
    capacity, so that patterns with slack stand in where none is exact.
    """
    lengths = np.unique(present)
    pieces, last = np.full(capacity + 1, capacity + 1), np.zeros(capacity + 1, np.int64)
    pieces[0] = 0
    for s in range(1, capacity + 1):
        fit = lengths[lengths <= s]
        if len(fit):
            k = int(pieces[s - fit].argmin())
            pieces[s], last[s] = pieces[s - fit[k]] + 1, fit[k]
    sums = np.where(pieces <= most - 2, np.arange(capacity + 1), 0)
    nearest = np.maximum.accumulate(sums)  # the largest sum of so few pieces that isn't above
    a = np.concatenate(([0], lengths))
    first, second = (x.ravel() for x in np.meshgrid(a, a, indexing="ij"))
    ok = (first >= second) & (first + second <= capacity)
    columns = [first[ok], second[ok]]
    rest = nearest[capacity - columns[0] - columns[1]]
    for _ in range(most - 2):
        columns.append(last[rest])
        rest = rest - last[rest]
    shapes = np.unique(-np.sort(-np.stack(columns, 1), 1), axis=0)
    return shapes[shapes.sum(1) >= (1 - ROOM) * capacity]


def fit(shapes: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the histogram, by accelerated projected gradient.

    Unfilled room costs a little, so of patterns that serve alike the fuller is taken.
    """
    bins = len(histogram)
    weight = np.arange(bins) / bins  # long pieces are hardest to place afterwards
    rows, columns = np.nonzero(shapes)
    at = shapes[rows, columns]
    slack = SLACK * (1 - shapes.sum(1) / (bins - 1))

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x[rows], bins)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(rows, r[at], len(shapes))

    load = times(np.ones(len(shapes)))
    step = 1 / max(1.0, float(np.max(back(weight * load))))
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (back(weight * (times(y) - histogram)) + slack))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that hold every piece of the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    if left.any():
        shapes = patterns(np.flatnonzero(left), capacity)
        x = fit(shapes, left.astype(float)) if len(shapes) else np.zeros(0)
        for rounded in (np.floor(x), np.ceil(x)):
            for i in np.argsort(-x, kind="stable"):
                want = int(rounded[i])
                shape = tuple(int(n) for n in shapes[i] if n)
                for n in set(shape):
                    want = min(want, int(left[n]) // shape.count(n))
                if want > 0:
                    out.append((shape, want))
                    for n in shape:
                        left[n] -= want
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing, on counts: sequences with equal contents are one group."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            gap = min((g for g, groups in room.items() if g >= n and groups), default=None)
            if gap is None:
                gap, contents, have = capacity, (), count
            else:
                contents, have = room[gap].popitem()
            each = min(gap // n, count)
            taken = min(have, count // each)
            if have > taken and contents:
                room[gap][contents] += have - taken
            room[gap - each * n][contents + (n,) * each] += taken
            count -= each * taken
    return [(contents, have) for groups in room.values() for contents, have in groups.items()]


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Intervals of ranks of each length: sorted keys (length and first rank), first sequence, offset."""
    length, first, sequence, offset = [], [], [], []
    filled: dict[int, int] = defaultdict(int)
    at = 0
    for shape, repeats in chosen:
        place = 0
        for n in shape:
            length.append(n)
            first.append(filled[n])
            sequence.append(at)
            offset.append(place)
            filled[n] += repeats
            place += n
        at += repeats
    key = np.array(length, np.int64) << 48 | np.array(first, np.int64)
    order = np.argsort(key)
    return key[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order]


def pack(df: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = written(pieces(df, ranks_path, pattern, capacity=capacity, end=end))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `capacity` rows at most
    keys, sequences, offsets = slots(plan(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    )
    ranked = (
        dealt.withColumn("n", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")))
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("n") - 1).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            want = b.column("length").to_numpy() << 48 | rank
            at = np.searchsorted(keys, want, "right") - 1
            number = sequences[at] + want - keys[at]
            yield pa.record_batch([*b.columns[:5], pa.array(number, pa.int64()), pa.array(offsets[at], pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
