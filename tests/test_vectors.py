"""Embedding texts of books made by hand."""

import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import vectors
from shelfmark.plans import registry


def test_snippet_text(spark):
    books = spark.createDataFrame([(1, "t" * 600, "Eve"), (2, "t" * 600, "Eve"), (3, None, None)], "book_id long, title string, author string")
    snippets = spark.createDataFrame([(1, 1, "later"), (1, 0, "s" * 600)], "book_id long, seq int, text string")
    got = {r["book_id"]: r for r in vectors.snippet_text(books, snippets).collect()}
    assert got[1]["embedding_text"] == "t" * 600 + " by Eve\n\nSnippet: " + "s" * 500 and got[2]["embedding_text"] == "t" * 600 + " by Eve"
    assert set(got) == {1, 2} and got[1]["point_id"] == "c4ca4238-a0b9-4382-adcc-509a6f75849b"


def _clustered(spark, n, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 20, 32))
    v = centre[rng.integers(0, len(centre), n)] + 0.35 * rng.standard_normal((n, 32))
    v[:copies] = v[0]
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def _brute(v, k):
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    score = np.round(u @ u.T, 6)
    np.fill_diagonal(score, -2)
    return {i: [(int(j), score[i, j]) for j in np.lexsort((np.arange(len(u)), -score[i]))[:k]] for i in range(len(u))}


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["neighbour_id"], r["score"]))
    return out


def test_exact_in_tiles(spark, monkeypatch):
    v, df = _clustered(spark, 700)
    want = _brute(v, 5)
    monkeypatch.setattr(vectors, "TILE", 100)
    got = _lists(vectors.nearest(df, 5, 1))
    assert got.keys() == want.keys() and all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want)
    assert set(_lists(vectors.nearest(df, 3, 50))) == set(range(0, 700, 50))


def test_index_over_all_rows(spark, monkeypatch):
    """Buckets are used, recall is above 0.9, and every score is exact."""
    v, df = _clustered(spark, 6000)
    want = _brute(v, 5)
    asked = []
    monkeypatch.setattr(vectors, "bits_for", lambda *a, f=vectors.bits_for: asked.append(f(*a)) or asked[-1])
    got = _lists(vectors.neighbours(df, 5))
    assert asked[0] >= 3 and len(got) == 6000
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / (5 * 6000) > 0.93
    best = {i: dict(want[i]) for i in want}
    assert all(abs(s - best[i][j]) < 1e-6 for i in got for j, s in got[i] if j in best[i])


def test_copies_of_a_third(spark):
    """A third of all rows is one vector: each copy has other copies, by id; other rows have their own neighbours."""
    v, df = _clustered(spark, 900, 3, 300)
    want = _brute(v, 5)
    got = _lists(vectors.neighbours(df, 5))
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[2]] == [0, 1, 3, 4, 5] and [j for j, _ in got[299]] == [0, 1, 2, 3, 4]
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in range(300, 900))


def test_odd_vectors(spark):
    """Nulls, zeros, NaN and null ids stay out; each width is searched; equal scores go to the smaller id."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.1, 0.0]), (10, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("q", F.lit(1))
    for got in (_lists(vectors.nearest(df, 2, 1)), _lists(vectors.neighbours(df, 2))):
        assert {i: [j for j, _ in x] for i, x in got.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 8: [9], 9: [8]}
    assert vectors.neighbours(df.limit(0)).count() == 0


def _as_sql(names, got, name, path):
    """Rows by query and by SQL over the same table, each as often as it stands there."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return Counter(tuple(r) for r in got) == Counter(want) and len(want) > 0


@pytest.mark.parametrize("name", ["D6_semantic_pairs", "E2_all_nearest"])
def test_all_rows_of_the_sql(spark, tmp_path, name):
    """Enough rows, far apart, for the index to leave some out, among them copies: every row is the SQL's, to the bit."""
    v = np.random.default_rng(5).standard_normal((3000, 16))
    v[:40] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    assert _as_sql(got.columns, got.collect(), name, f"{tmp_path}/embeddings.parquet")


def test_ties_and_repeated_ids(spark, tmp_path, monkeypatch):
    """Few distinct cosines, copies, multiples, and ids that stand on several rows, in many small blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 3 * 64)
    v = np.random.default_rng(2).integers(-1, 3, (900, 3))
    v[(v == 0).all(1)] = 1
    for at, ids in (("once", np.random.default_rng(3).permutation(900)), ("again", np.arange(900) % 600)):
        spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v.astype(float))], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{at}")
        got = vectors.all_nearest(spark.read.parquet(f"{tmp_path}/{at}"), 5)
        names = ["query_id", "neighbour_id", "score", "rank"]
        assert got.columns == names and _as_sql(names, got.collect(), "E2_all_nearest", f"{tmp_path}/{at}")


@pytest.mark.parametrize("noise", [1.0, 1e-3, 1e-5])
def test_steps_of_a_tile(monkeypatch, noise):
    """Two blocks in small steps: far apart, so near that single precision can't tell them, and all but equal; huge and tiny ones among them."""
    monkeypatch.setattr(vectors, "ROWS", 37)
    monkeypatch.setattr(vectors, "COLUMNS", 53)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(24) + noise * rng.standard_normal((400, 24))
    v[::7] *= 1e-200
    v[::11] *= 1e180
    ids = rng.permutation(400)
    a, b = (vectors._Block.of(pa.table({"vec_id": pa.array(ids[x]), "embedding": pa.array(v[x].tolist())}), 24, 5) for x in (slice(0, 150), slice(150, 400)))
    vectors._meet(a, b, 5)
    for own, other in ((a, b), (b, a)):
        x, y = np.indices((len(own.ids), len(other.ids))).reshape(2, -1)
        score = vectors._cosine(own, x, other, y).reshape(len(own.ids), -1)
        best = np.array([np.lexsort((other.ids, -s))[:5] for s in score])
        assert (own.best == other.ids[best]).all() and (own.score == np.take_along_axis(score, best, 1)).all()
        u = [z.v / np.linalg.norm(z.v, axis=1, keepdims=True) for z in (own, other)]
        assert np.abs(score - u[0] @ u[1].T).max() < 1e-6


@pytest.mark.parametrize("ids", [1, 3000])
def test_tiles_do_not_grow(spark, monkeypatch, ids):
    """A row travels once for each block, whatever its neighbours; no tile is larger than two blocks, also where all rows are one row."""
    v = np.random.default_rng(6).standard_normal((ids, 8))
    df = spark.createDataFrame([(i % ids, v[i % ids].tolist()) for i in range(3000)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 100 * 8)
    sent, tiles = vectors._dealt(vectors.written(vectors.sound(df)))
    size = [r["count"] for r in sent.groupBy("width", "i", "j").count().collect()]
    assert tiles == 30 * 31 // 2 == len(size) and sum(size) == 3000 * 30 and max(size) <= 300
    sent, tiles = vectors._dealt(vectors.sound(df.limit(0)))
    assert sent.count() == 0 and tiles == 1


def test_memory_of_ties():
    """All rows of two blocks lie in three directions, so scores tie everywhere: a step's arrays are bounded, and the smallest ids win."""
    n, k = 3000, 5
    v = np.eye(3)[np.arange(2 * n) % 3] * np.arange(1, 2 * n + 1)[:, None]
    a, b = (vectors._Block.of(pa.table({"vec_id": pa.array(np.arange(2 * n)[x::2]), "embedding": pa.array(v[x::2].tolist())}), 3, k) for x in (0, 1))
    tracemalloc.start()
    vectors._meet(a, b, k)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    for own, other in ((a, b), (b, a)):
        assert (own.score == 1).all() and all((x == other.ids[other.ids % 3 == i % 3][:k]).all() for i, x in zip(own.ids, own.best))
