"""Embedding texts, and cosine neighbours: exactly in tiles, of some vectors or all, or of all by random hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.graph import written


def snippet_text(books: DataFrame, snippets: DataFrame, most: int = 500) -> DataFrame:
    """E1 in whole: title and author uncut, then `most` characters of the first snippet; a stable id from the book's key. Blank texts go."""
    first = snippets.groupBy("book_id").agg(F.min_by(F.coalesce("text", F.lit("")), "seq").alias("first"))
    by = F.when(F.col("author") != "", F.concat(F.lit(" by "), "author")).otherwise("")
    more = F.when(F.col("first").isNotNull(), F.concat(F.lit("\n\nSnippet: "), F.substring("first", 1, most))).otherwise("")
    h = F.md5(F.col("book_id").cast("string"))
    point = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return books.join(first, "book_id", "left").select("book_id", F.concat(F.coalesce("title", F.lit("")), by, more).alias("embedding_text"), point.alias("point_id")).where(F.trim("embedding_text") != "")


#: Rows of a tile on either side; tables of the index; the recall that its bits are chosen for, and the queries that are scored exactly for that.
TILE, TABLES, RECALL, PROBES = 4096, 16, 0.97, 256
_PAIR = "query_id long, neighbour_id long, score double"
#: Of the search of all by all: numbers that a block of vectors holds at most; blocks that a table is cut into where each keeps `FEW` rows; queries and rows of a step; pairs that are scored at once, in numbers.
BLOCK, BLOCKS, FEW, ROWS, COLUMNS, SCORED = 1 << 22, 16, 2048, 512, 1024, 1 << 20


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, width of the rows that have a direction; null, empty and unfinite vectors and null ids stay out. Vectors of different widths are never compared."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where((F.size("embedding") > 0) & fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("width"))


def _unit(column: pa.Array) -> np.ndarray:
    v = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _best(ids: np.ndarray, q: np.ndarray, others: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of `others` for each query, ties to the smaller id, the query itself left out."""
    order = np.argsort(others, kind="stable")
    others, v = others[order], v[order]
    out = []
    for at in range(0, len(ids), 512):
        score = np.round(q[at : at + 512] @ v.T, 6)
        score[ids[at : at + 512, None] == others] = -np.inf
        if len(others) > 4 * k + 16:  # what isn't below the k-th score, then in order
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            x, y = np.nonzero(score >= least[:, None])
        else:
            x, y = (z.ravel() for z in np.indices(score.shape))
        s = score[x, y]
        by = np.lexsort((y, -s, x))
        x, y, s = x[by], y[by], s[by]
        place = np.arange(len(x)) - np.searchsorted(x, x, "left")
        keep = (place < k) & np.isfinite(s)
        out.append((ids[at : at + 512][x[keep]], others[y[keep]], s[keep]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _tiled(rows: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows with equal keys for each row of `asked` (keys, vec_id, embedding): a group is cut into tiles of at most about `TILE` queries by `TILE` rows,
    each of which sends k rows for each of its queries. A group's tiles are as many tasks' work as it needs, so its size doesn't matter."""
    parts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    cuts = parts(rows, "n_row").join(parts(asked, "n_query"), keys)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.join(cuts, keys).withColumn("r", own("n_row")).withColumn("q", every("n_query"))
    query = asked.join(cuts, keys).withColumn("q", own("n_query")).withColumn("r", every("n_row"))
    columns = [*keys, "q", "r", "vec_id", "embedding"]
    both = data.select(*columns, F.lit(False).alias("asks")).unionByName(query.select(*columns, F.lit(True).alias("asks")))

    def score(tile: pa.Table) -> pa.Table:
        asks = tile["asks"].combine_chunks()
        q, v = tile.filter(asks), tile.filter(pa.compute.invert(asks))
        if q.num_rows and v.num_rows:
            got = _best(q["vec_id"].to_numpy(), _unit(q["embedding"]), v["vec_id"].to_numpy(), _unit(v["embedding"]), k)
        else:
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table([*map(pa.array, got)], ["query_id", "neighbour_id", "score"])

    return both.groupBy(*keys, "q", "r").applyInArrow(score, _PAIR)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest by cosine for the vectors whose id is divisible by `every`, exactly; 1 asks for all.

    A blocked product of queries and rows: both travel to tiles, nothing to the driver. The work is queries times rows.
    """
    rows = sound(vectors)
    return _ranked(_tiled(rows, rows.where(F.col("vec_id") % every == 0), ["width"], k), k).select("query_id", "neighbour_id", "score", "rank")


@dataclass
class _Block:
    """Vectors of one width by id, scaled by powers of two so that no square leaves the range, and the best that each has found so far."""

    ids: np.ndarray
    v: np.ndarray
    square: np.ndarray
    unit: np.ndarray
    best: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, width: int, k: int) -> _Block:
        ids = t["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.asarray(t["embedding"].combine_chunks().flatten(), np.float64).reshape(len(ids), width)[order]
        v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True, initial=0))[1])
        square = np.zeros(len(ids))
        for x in v.T:  # in order, as the SQL's engine sums
            square += x * x
        return cls(ids[order], v, square, (v / np.sqrt(square)[:, None]).astype(np.float32), np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.nonzero(self.score > -np.inf)
        return self.ids[x], self.best[x, y], self.score[x, y]


def _cosine(a: _Block, x: np.ndarray, b: _Block, y: np.ndarray) -> np.ndarray:
    """Rounded cosines, to the bit as the SQL's engine has them: sums in order, one root, halves away from zero."""
    out, step = np.empty(len(x)), max(1, SCORED // a.v.shape[1])
    for at in range(0, len(x), step):
        p, q = x[at : at + step], y[at : at + step]
        c = 1e6 * np.clip(np.cumsum(a.v[p] * b.v[q], axis=1)[:, -1] / np.sqrt(a.square[p] * b.square[q]), -1, 1)
        whole = np.trunc(c)
        out[at : at + step] = (whole + np.copysign(1.0, c) * (np.abs(c - whole) >= 0.5)) / 1e6
    return out


def _product(a: _Block, x: int, b: _Block, y: int, kind: type) -> np.ndarray:
    """Cosines about, of a step of rows of either block; equal ids have none."""
    u, w = a.unit[x : x + ROWS], b.unit[y : y + COLUMNS]
    if kind is np.float64:
        u, w = (c.v[at : at + n] / np.sqrt(c.square[at : at + n])[:, None] for c, at, n in ((a, x, ROWS), (b, y, COLUMNS)))
    score = u @ w.T
    low, high = (np.searchsorted(b.ids[y : y + COLUMNS], a.ids[x : x + ROWS], side) for side in ("left", "right"))
    n = high - low
    if n.any():
        score[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(low + n - np.cumsum(n), n)] = -np.inf
    return score


def _offer(score: np.ndarray, slack: float, axis: int, own: _Block, at: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `score` of what may be among the k best of each row (axis 0) or column (1): steps come by ascending id, so against k found ones only a higher rounded score counts."""
    kth = own.score[at : at + score.shape[axis], -1]
    floor = np.where(kth < 1, kth + (5e-7 - slack), np.inf)
    if np.isneginf(kth).any() and score.shape[1 - axis] > k:
        floor = np.maximum(floor, np.partition(score, -k, axis=1 - axis).take(-k, axis=1 - axis) - (2 * slack + 1e-6))
    floor = np.nextafter(floor.astype(score.dtype), score.dtype.type(-np.inf))
    hit = np.flatnonzero(score >= (floor if axis else floor[:, None]))
    return np.divmod(hit[score.ravel()[hit] > -np.inf], score.shape[1])


def _take(own: _Block, q: np.ndarray, other: _Block, y: np.ndarray, k: int) -> None:
    """Score these pairs exactly and keep the k best of each query, ties to the smaller id."""
    s = _cosine(own, q, other, y)
    more = s > own.score[q, -1]
    q, y, s = q[more], y[more], s[more]
    u = np.unique(q)
    query, ids, s = np.concatenate([np.repeat(u, k), q]), np.concatenate([own.best[u].ravel(), other.ids[y]]), np.concatenate([own.score[u].ravel(), s])
    by = np.lexsort((ids, -s, query))
    query, ids, s = query[by], ids[by], s[by]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    own.best[u], own.score[u] = ids[keep].reshape(-1, k), s[keep].reshape(-1, k)


def _meet(a: _Block, b: _Block, k: int) -> None:
    """Every row of `a` with every row of `b`, both ways at once unless they are one block. Single precision chooses by its error bound what is scored exactly; where that leaves much, double precision chooses."""
    rough, fine = ((a.v.shape[1] + 8) * np.finfo(kind).eps for kind in (np.float32, np.float64))
    for x in range(0, len(a.ids), ROWS):
        for y in range(0, len(b.ids), COLUMNS):
            score, closer = _product(a, x, b, y, np.float32), None
            for axis, own, at in ((0, a, x), (1, b, y))[: 1 if a is b else 2]:
                i, j = _offer(score, rough, axis, own, at, k)
                if len(i) > score.size // 16:
                    closer = _product(a, x, b, y, np.float64) if closer is None else closer
                    i, j = _offer(closer, fine, axis, own, at, k)
                if len(i):
                    _take(*((a, x + i, b, y + j) if axis == 0 else (b, y + j, a, x + i)), k)


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each row once for every block of its width: width, i, j (the tile: two blocks, or one with itself), second (the row's is the later of two), vec_id, embedding; and how many tiles there are.

    Rows are dealt to blocks by id and place, so a block's size doesn't grow with the table, nor with equal rows. Nothing reaches the driver but the count.
    """
    many = max(BLOCKS, ceil(2 * rows.sparkSession.sparkContext.defaultParallelism**0.5))
    wanted = F.greatest(F.ceil(F.col("n") * F.col("width") / BLOCK), F.least(F.lit(many), F.ceil(F.col("n") / FEW)))
    cuts = rows.groupBy("width").agg(F.count("*").alias("n")).select("width", wanted.cast("int").alias("blocks"))
    tiles = int(cuts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1.0) / 2)).first()[0] or 1)
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")  # equal rows to different blocks
    sent = rows.join(F.broadcast(cuts), "width").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.select("width", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), (F.col("own") > F.col("met")).alias("second"), "vec_id", "embedding"), tiles


def _all_pairs(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of equal width for each row, out of every block of rows. The work is rows times rows, halved as a product serves both; each tile is one task's."""

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        width, i, j = (x.as_py() for x in key)
        second = t["second"].combine_chunks()
        a = _Block.of(t.filter(pa.compute.invert(second)), width, k)
        b = a if i == j else _Block.of(t.filter(second), width, k)
        _meet(a, b, k)
        found = a.pairs() if a is b else map(np.concatenate, zip(a.pairs(), b.pairs()))
        return pa.table([*map(pa.array, found)], ["query_id", "neighbour_id", "score"])

    sent, tiles = _dealt(rows)
    keys = ["width", "i", "j"]  # by number: partitions of few bytes would be joined else, and these have much to do
    return sent.repartition(min(tiles, 1 << 14), *keys).groupBy(*keys).applyInArrow(tile, _PAIR)


def all_nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    """E2 for every vector, exactly: what `neighbours` finds most of.

    Rows of equal vectors are searched once, unless ids repeat: then each row is searched by itself, and an id has the k best that its rows have found.
    """
    rows = written(sound(vectors))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return _ranked(_all_pairs(rows, k), k).select("query_id", "neighbour_id", "score", "rank")
    classes, distinct = _classes(rows)
    return _to_members(rows, classes, _ranked(_all_pairs(distinct, k), k), k)


def bits_for(scores: list[float], tables: int, rows: int, recall: float = RECALL) -> int:
    """The most bits a table may have so that neighbours at these cosines share a bucket of some table with the wanted probability, on average; no more than leave a few hundred rows to a bucket."""
    alike = 1 - np.arccos(np.clip(np.array(scores), -1, 1)) / np.pi
    most = max(0, int(np.log2(max(1, rows / 256))))
    return max((b for b in range(most + 1) if len(scores) and (1 - (1 - alike**b) ** tables).mean() >= recall), default=0)


def _buckets(rows: DataFrame, tables: int, bits: int) -> DataFrame:
    """A row for each table, with the sides of its random hyperplanes that the vector lies on. The hyperplanes come from a fixed seed for each width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column("width").to_numpy()
            for width in np.unique(widths):
                part = b.take(pa.array(np.flatnonzero(widths == width)))
                planes = np.random.default_rng([7, int(width)]).standard_normal((tables * bits, width))
                side = (_unit(part.column("embedding")) @ planes.T > 0).reshape(part.num_rows, tables, bits)
                bucket = (side * (1 << np.arange(bits))).sum(2)
                for t in range(tables):
                    yield pa.record_batch([part.column("vec_id"), part.column("embedding"), part.column("width"), pa.array(np.full(part.num_rows, t), pa.int32()), pa.array(bucket[:, t], pa.int64())], ["vec_id", "embedding", "width", "table", "bucket"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, width int, table int, bucket long")


def neighbours(vectors: DataFrame, k: int = 5, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """E2 for every vector: an index of random-hyperplane tables over all rows, candidates re-scored exactly.

    Rows of equal vectors are searched once, and every member gets the class's neighbours and its fellow members. A table has as many bits as the wanted recall
    allows, by the cosines of the true neighbours of `PROBES` vectors, found exactly; where neighbours are far apart that may be none,
    and the search is the exact one. `all_nearest` is the exact way.
    """
    rows = written(sound(vectors))
    classes, distinct = _classes(rows)
    probes = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES)
    scores = [r["score"] for r in _ranked(_tiled(distinct, probes, ["width"], k), k).select("score").collect()]  # PROBES times k at most
    bits = bits_for(scores, tables, distinct.count(), recall)
    if bits:
        dealt = written(_buckets(distinct, tables, bits))
        found = _tiled(dealt, dealt, ["width", "table", "bucket"], k).distinct()
    else:
        found = _tiled(distinct, distinct, ["width"], k)
    return _to_members(rows, classes, _ranked(found, k), k)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """embedding, class_id (the smallest id), n, width of the rows of equal vectors; and a row of each."""
    classes = written(rows.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("width").alias("width")))
    return classes, classes.select(F.col("class_id").alias("vec_id"), "embedding", "width")


def _to_members(rows: DataFrame, classes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every row, from the k best classes of each class."""
    near = found.select(F.col("query_id").alias("class_id"), F.col("neighbour_id").alias("other"), "score")
    several = classes.where("n > 1").select("embedding", "class_id")
    member = rows.join(several, "embedding").select("vec_id", "class_id")
    few = _first_ids(member, k + 1)
    others = near.join(few.withColumnRenamed("class_id", "other"), "other", "left").select("class_id", F.coalesce("id", "other").alias("neighbour_id"), "score")
    own = few.select("class_id", F.col("id").alias("neighbour_id"), F.lit(1.0).alias("score"))
    w = Window.partitionBy("class_id").orderBy(F.desc("score"), "neighbour_id")
    each = others.unionByName(own).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).drop("place")
    asked = member.unionByName(classes.where("n = 1").select(F.col("class_id").alias("vec_id"), "class_id"))
    pairs = asked.join(each, "class_id").where("vec_id <> neighbour_id").select(F.col("vec_id").alias("query_id"), "neighbour_id", "score")
    return _ranked(pairs, k).select("query_id", "neighbour_id", "score", "rank")


def _first_ids(member: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """class_id, id: the smallest ids of each class; in parts first, since a class may hold a third of all rows."""
    one = Window.partitionBy("class_id", "salt").orderBy("vec_id")
    parts = member.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("place", F.row_number().over(one)).where(F.col("place") <= most)
    all_parts = Window.partitionBy("class_id").orderBy("vec_id")
    return parts.withColumn("place", F.row_number().over(all_parts)).where(F.col("place") <= most).select("class_id", F.col("vec_id").alias("id"))


def open_embeddings(texts: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """The distinct requests that the cache doesn't hold. `texts`: text; `cache`: request_hash."""
    made = texts.select(F.sha2(F.concat_ws("|", F.lit(provider), F.lit(model), "text"), 256).alias("request_hash")).groupBy("request_hash").agg(F.count("*").alias("n_requests"))
    return made.join(cache, "request_hash", "left_anti")
