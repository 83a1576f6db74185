"""The pipeline's stages on odd inputs, the quality score by its definition, and op10's digests against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bpe, neardups, quality

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, group string, _near_id string, score string, t string"
LONG = " ".join(f"w{i % 997}" for i in range(20000))
PROSE = "It was a quiet morning in the harbour, and the boats lay still. People walked along the quay and talked about the weather, the price of fish and the coming winter. " * 4
ROWS = [(None, PROSE, "en"), (1, None, "en"), (2, "", None), (3, LONG, "en"), (4, PROSE, "en"), (4, PROSE, "en"), (5, PROSE + "One more word.", "en"), (6, "password=abcdef1234", None), (7, "\x00\x1f 12 !?", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, x, "s", 1, "g", "i", "s", "t") for d, t, x in ROWS], KIND)


def test_keep_one_on_odd_rows(spark, odd):
    """Rows without an id stay, repeated rows leave one, near copies leave the smallest id; all columns of the input come out, whatever their names."""
    got = neardups.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(d), t) for d, t in [(None, PROSE), (1, None), (2, ""), (3, LONG), (4, PROSE), (6, "password=abcdef1234"), (7, "\x00\x1f 12 !?")])
    assert neardups.keep_one(odd.limit(0)).count() == 0


def test_keep_on_odd_rows(spark, odd):
    """A row stays where its own text's score reaches the threshold; without labels the share decides for all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.fold("doc_id", 5) != 0)
    kept = quality.keep(odd, model)
    scores = {(r["doc_id"], i): r["score"] for i, r in enumerate(quality.score(odd.coalesce(1), model).collect())}
    want = sum(s >= quality.THRESHOLD for s in scores.values())
    assert kept.columns == odd.columns and kept.count() == want
    assert quality.keep(odd, 0.5).count() == len(ROWS) and quality.keep(odd, 0.0).count() == 0 and quality.keep(odd.limit(0), model).count() == 0


def test_score_by_definition(spark):
    """The score is the logistic of the calibrated difference of the two classes' Gaussian log densities, computed here with plain inverses and determinants."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.fold("doc_id", 5) != 0)
    rows = docs.orderBy("doc_id").limit(60).select("doc_id", "text").toArrow()
    x = quality.statistics(rows.column("text").combine_chunks())
    z = (x - model.center) / model.scale
    density = []
    for mean, factor in zip(model.means, model.factors):
        inverse = factor.T @ factor
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z - mean, inverse, z - mean) - np.linalg.slogdet(inverse)[1]))
    want = 1 / (1 + np.exp(-(model.slope * np.clip(density[1] - density[0], -200, 200) + model.shift)))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert np.allclose([got[d] for d in rows.column("doc_id").to_pylist()], want, atol=1e-6)


def test_quality_learns_from_all_rows(spark):
    """Means, covariances and calibration by brute force over every labelled row, more than any sample of old held."""
    r = np.random.default_rng(4)
    words = ["harbour", "Boats", "123", "!!", "#$%", "weather", "a", "quiet,"]
    texts = [" ".join(words[k] for k in r.integers(0, 8 if i % 2 else 6, r.integers(5, 30))) for i in range(12000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(12000)], "doc_id long, quality int"), quality.F.lit(True))
    x, y = quality.statistics(pa.array(texts)), np.arange(12000) % 2
    assert np.allclose(model.center, x.mean(0), atol=1e-4) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-4)
    z = (x - model.center) / model.scale
    pooled = sum(z[y == k].var(0) for k in (0, 1)) / 2 + 1e-3
    for k in (0, 1):
        assert np.allclose(model.means[k], z[y == k].mean(0), atol=1e-3)
        cov = (1 - quality.SHRINK) * np.cov(z[y == k], rowvar=False, bias=True) + quality.SHRINK * np.diag(pooled)
        assert np.allclose(np.linalg.inv(model.factors[k].T @ model.factors[k]), cov, atol=1e-2)
    m = model.margin(x)
    p = 1 / (1 + np.exp(-(model.slope * m + model.shift)))
    assert abs((p - y).mean()) < 1e-4 and abs(((p - y) * m).mean()) < 1e-3  # the fit's own conditions


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """All stages on nulls, copies and clashing columns: every stage returns the columns of its input, the last one whole pieces; and on no rows."""
    import corpus_pipeline as p

    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        top = str(tmp_path / name)
        docs.write.parquet(f"{top}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{top}/labels.parquet")
        now = spark.read.parquet(f"{top}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            after = p.written(stage(spark, now, top))
            assert after.columns == now.columns and after.count() <= now.count()
            now = after
        pieces = p.run(spark, top).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in now.collect()}
        by = {}
        for r in pieces:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024


def test_bpe_digests(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.digests(docs, path).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
