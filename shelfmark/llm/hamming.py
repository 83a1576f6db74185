"""Exact top-k search over binary codes by incremental multi-index hashing.

Every distinct code is indexed by disjoint segments, cut for the least expected cost: narrow
ones meet more codes that must be verified, wide ones need more probes, which are shuffled. In round r each open query looks up the values at distance r from its own,
segment by segment, as an equi-join on (segment, value); no pair of blocks and
no pair without a common value ever meets. A code counts in the first round and
segment that show it, which its distances by segment tell, so nothing is
deduplicated, and only where it is no farther than the query's k-th so far. After round r all codes within distance m * (r + 1) - 1 (of m segments)
have been seen; a query is closed when its k-th verified distance is at most that. Each
further segment looked up at r + 1 covers one more unit of distance, so a query whose
k-th distance is under m away from that looks up so many segments only, and closes.

A query may be far from everything. Where the values of the next round would be more
than the distinct codes, the rest of the open queries is compared with all codes in
blocks of `BLOCK` queries, as a scan.

Skew: codes that many rows share are one row of the index, with the smallest id;
its further ids come in at the end, k + 1 at most. A code holds a mean-centred sign
for each dimension, so a segment's values are spread by construction; a value that
many codes hold is split by adaptive execution, since both sides of the join are plain
exchanges (no side is broadcast: exploded tables are larger than they look). What is shuffled after a round is bounded by k + 1 rows for each query
and task (the window's group limit).

Defined results: rows with a null id, a null or empty vector, or one with nulls
or another length than most have no code and are neither found nor asked;
repeated rows count once; a query is never its own neighbour; ties go to the smaller
id; fewer than k others give fewer rows; extra columns are ignored. Codes of more than
`BITS` bits are several words: code, code1, code2 and so on.
"""

from __future__ import annotations

from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm._text import written

K = 10
BITS = 64
BLOCK = 4096
#: Segments of a 64-bit word, at most; comparisons that cost as much as one probe, shuffled and sorted.
MOST = 8
PROBE = 20


def sign_codes(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, code, code1, ...): bit i of word j tells whether dimension 64 * j + i is above its mean over all rows."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    width = rows.agg(F.mode(F.size("v"), deterministic=True)).first()[0]
    if width is None:
        return rows.select("id", F.lit(0).cast("long").alias("code"))
    whole = rows.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    means = whole.agg(*[F.avg(F.get("v", i)).alias(f"m{i}") for i in range(width)]).first()
    words = []
    for at in range(0, width, BITS):
        word = F.lit(0).cast("long")
        for i in range(min(BITS, width - at)):
            word = word.bitwiseOR(F.when(F.get("v", at + i) > F.lit(means[at + i]), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(word.alias(f"code{at // BITS or ''}"))
    return whole.select("id", *words)


def segments(words: list[str], count: int, k: int = K) -> list[tuple[str, int, int]]:
    """(word, shift, width) of the segments that cost least for `count` codes, were all bits independent and even."""
    bits, near, reach = BITS * len(words), 0, 0
    while reach < bits and count * (near + comb(bits, reach)) < (k + 1) << bits:  # `reach`: where the k-th neighbour is expected
        near, reach = near + comb(bits, reach), reach + 1

    def cost(each: int) -> float:
        radius, more = divmod(reach + 1, each * len(words))
        width = BITS // each
        return (each * len(words) * sum(comb(width, i) for i in range(radius)) + more * comb(width, radius)) * (PROBE + count / 2**width)

    each = min(range(2, MOST + 1), key=cost)
    edges = [BITS * i // each for i in range(each + 1)]
    return [(w, a, b - a) for w in words for a, b in zip(edges, edges[1:])]


def _value(word: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _distance(words: list[str]) -> Column:
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"q_{w}"))) for w in words), F.lit(0)).cast("int")


def _least(found: DataFrame, asked: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*asked).orderBy("distance", "least")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def top_k(index: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): both sides have id and the words of a code."""
    words = [c for c in index.columns if c.startswith("code")]
    asked = [f"q_{w}" for w in words]
    index = written(index.where(F.col("code").isNotNull()).select("id", *words).distinct())
    codes = written(index.groupBy(*words).agg(F.min("id").alias("least")))
    total = codes.count()
    parts = segments(words, total, k)
    open_ = written(queries.where(F.col("code").isNotNull()).select(*[F.col(w).alias(q) for w, q in zip(words, asked)]).distinct().withColumns({"need": F.lit(len(parts)), "far": F.lit(None).cast("int")}))
    pack = F.array(*[F.struct(F.lit(i).alias("segment"), _value(F.col(w), a, n).alias("value")) for i, (w, a, n) in enumerate(parts)])
    tables = codes.select(*words, "least", F.inline(pack))
    lookups = F.array(*[F.struct(F.lit(i).alias("segment"), _value(F.col(f"q_{w}"), a, n).alias("value"), F.lit(-1).alias("last"), F.lit(n).alias("width")) for i, (w, a, n) in enumerate(parts)])
    apart = [F.bit_count(_value(F.col(w).bitwiseXOR(F.col(f"q_{w}")), a, n)) for w, a, n in parts]
    best, closed = None, []
    radius, most = 0, max(n for *_, n in parts)
    while open_.limit(1).count():
        if radius > most or sum(comb(n, radius) for *_, n in parts) > total:
            closed.append(_scan(codes, open_.select(*asked), words, k + 1, block))
            break
        probes = open_.select(*asked, "far", "need", F.inline(lookups)).where("segment < need").drop("need")
        for _ in range(radius):  # one more bit above the last one flipped: every set of `radius` bits once
            probes = probes.where("last < width - 1").withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.col("width") - 1)))
            probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, last)")))
        probes = probes.drop("last", "width")
        nth = F.lit(len(parts))
        for i, d in reversed(list(enumerate(apart))):
            nth = F.when(d == radius, i).otherwise(nth)
        new = (F.col("far").isNull() | (_distance(words) <= F.col("far"))) & (F.least(*apart) == radius) & (F.col("segment") == nth)
        found = probes.join(tables.hint("merge"), ["segment", "value"]).where(new).select(*asked, *words, "least", _distance(words).alias("distance"))
        if best is not None:
            found = found.unionByName(best.join(open_.select(*asked).hint("merge"), asked, "left_semi"))
        best = written(_least(found, asked, k + 1))
        seen = len(parts) * (radius + 1) - 1
        known = best.groupBy(*asked).agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(F.col("n") > k)
        lacks = F.when(F.col("far").isNull(), len(parts)).otherwise(F.least(F.greatest(F.col("far") - seen, F.lit(0)), F.lit(len(parts))))
        now = F.when(F.col("need") < len(parts), 0).otherwise(lacks)
        state = written(open_.drop("far").join(known.hint("merge"), asked, "left").select(*asked, now.alias("need"), "far"))
        closed.append(best.join(state.where("need = 0").hint("merge"), asked, "left_semi"))
        open_ = state.where("need > 0")
        radius += 1
    if not closed:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).alias("distance")).where("false")
    near = closed[0]
    for c in closed[1:]:
        near = near.unionByName(c)
    few = index.withColumn("n", F.row_number().over(Window.partitionBy(*words).orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    ids = near.join(few.withColumnRenamed("id", "neighbour_id").hint("merge"), words).select(*asked, "neighbour_id", "distance")
    w = Window.partitionBy(*asked).orderBy("distance", "neighbour_id")
    ids = ids.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")
    each = queries.select("id", *[F.col(c).alias(q) for c, q in zip(words, asked)]).distinct().join(ids.hint("merge"), asked).where(F.col("id") != F.col("neighbour_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "neighbour_id", "distance")


def _scan(codes: DataFrame, open_: DataFrame, words: list[str], k: int, block: int) -> DataFrame:
    """The k nearest codes of queries that no radius serves, against all codes: `block` queries at a time reach every task."""
    asked = [f"q_{w}" for w in words]
    blocks = -(-open_.count() // block)
    dealt = written(open_.withColumn("b", F.pmod(F.xxhash64(*asked), F.lit(blocks))))
    out = None
    for b in range(blocks):
        part = dealt.where(F.col("b") == b).drop("b").agg(F.collect_list(F.struct(*asked)).alias("q"))  # about `block` codes
        pairs = codes.join(F.broadcast(part)).select(*words, "least", F.inline("q")).select(*asked, *words, "least", _distance(words).alias("distance"))
        got = _least(pairs, asked, k)
        out = got if out is None else out.unionByName(got)
    return out


def search(df: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """op8: the queries are the rows whose id is divisible by `every`, against all rows."""
    codes = written(sign_codes(df))
    return top_k(codes, codes.where(F.col("id") % every == 0), k)
