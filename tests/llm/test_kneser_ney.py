"""The n-gram model against a plain one in dictionaries, sums of probabilities, SQL, and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import kneser_ney

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, score string, n_tokens string, shard string, h string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " end"]


class Plain:
    """The definition of the module's docstring, n-gram by n-gram."""

    def __init__(self, texts, order):
        self.order = order
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            s = [" start", *words(t)]
            for n in range(1, order + 1):
                grams[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(max(n - 1, 1), len(s)))
        self.raw = Counter({k[0]: c for k, c in grams[1].items()})
        self.value = [None] * (order + 1)
        self.value[order] = grams[order]
        for n in range(order - 1, 0, -1):
            left = Counter(k[1:] for k in grams[n + 1])
            self.value[n] = {k: left[k] or c for k, c in grams[n].items()}
        self.d = [None] + [self.discounts(Counter(v.values())) for v in self.value[1:]]
        self.contexts = [defaultdict(lambda: [0, 0.0]) for _ in range(order + 1)]
        for n in range(1, order + 1):
            for k, v in self.value[n].items():
                of = self.contexts[n][k[:-1]]
                of[0] += v
                of[1] += self.d[n][min(v, 3)]

    @staticmethod
    def discounts(c):
        if not all(c[i] for i in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = c[1] / (c[1] + 2 * c[2])
        return [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k], 0), k) for k in (1, 2, 3))]

    def p(self, context, w):
        p = 1 / (len(self.raw) + 1)
        for n in range(1, min(self.order, len(context) + 1) + 1):
            c = tuple(context[len(context) - n + 1 :])
            if c not in self.contexts[n]:
                break
            total, rest = self.contexts[n][c]
            v = self.value[n].get((*c, w), 0)
            p = max(v - self.d[n][min(v, 3)], 0) / total + rest / total * p
        return p

    def score(self, text):
        s = [" start", *words(text)]
        return sum(math.log10(self.p(s[:i], s[i])) for i in range(1, len(s)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model(spark, docs, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD", 40_000)
    monkeypatch.setattr(kneser_ney, "WORD_SHARD", 100_000)
    rows = docs.select("doc_id", "text").collect()
    train = [r["text"] for r in rows if r["doc_id"] % 3]
    plain = Plain(train, order)
    model = kneser_ney.train(docs.where("doc_id % 3 <> 0"), order)
    assert model.levels[0].shards > 1 and model.levels[1].shards > 1
    assert model.words == len(plain.raw) and model.train_tokens == sum(plain.raw.values())
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, model).collect()}
    for r in rows[:60]:
        g, ws = got[r["doc_id"]], words(r["text"])
        assert g["n_tokens"] == len(ws) and g["n_known"] == sum(w in plain.raw for w in ws)
        assert math.isclose(g["score"], plain.score(r["text"]), rel_tol=1e-9, abs_tol=1e-5)
        base = sum(math.log10((plain.raw[w] + 1) / (model.train_tokens + model.words + 1)) for w in ws)
        assert math.isclose(g["base_score"], base, rel_tol=1e-9, abs_tol=1e-5)
        assert math.isclose(g["perplexity"], 10 ** (-g["score"] / len(ws)), rel_tol=1e-6)


def test_hot_contexts(spark, docs, monkeypatch):
    """Contexts that are spread over the shards give the same numbers."""
    rows = [(i, " ".join(random.Random(i).choice(["a", "a", "b", f"w{j % 17}"]) for j in range(60))) for i in range(40)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Plain([t for _, t in rows], 2)
    monkeypatch.setattr(kneser_ney, "SHARD", 500)
    model = kneser_ney.train(some, 2)
    assert model.levels[1].shards > 8
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(some, model).collect()}
    assert all(math.isclose(got[i], plain.score(t), rel_tol=1e-9, abs_tol=1e-5) for i, t in rows)
    r = kneser_ney.Reader(model)
    assert {int(r.shard(2, c, c)[0]) for c in map(lambda x: __import__("numpy").array([x]), range(5))} <= set(range(model.levels[1].shards))


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, after any context."""
    plain = Plain(["a b c a b d", "b c a", "a a b", "d c b a"] * 2, 3)
    for context in ([" start"], [" start", "a"], [" start", "a", "b"], ["zz"], ["c", "a"]):
        assert math.isclose(sum(plain.p(context, w) for w in [*plain.raw, "unknown"]), 1.0)


def test_contract(spark, docs):
    got = {r["doc_id"]: r for r in kneser_ney.scored(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    out = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
    plain = Plain([r["text"] for r in rows if not out[r["doc_id"]]], 2)
    assert len(got) == len(rows) and all(g["held_out"] == out[d] for d, g in got.items())
    assert all(math.isclose(got[r["doc_id"]]["score"], plain.score(r["text"]), rel_tol=1e-9, abs_tol=1e-5) for r in rows[:80])
    held = [g for d, g in got.items() if out[d]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)  # better than add-one on what it hasn't seen


def test_odd_inputs(spark):
    """Null ids and texts, empty and long texts, repeated rows, other columns of clashing names, no rows, nothing to learn from."""
    long = "word " * 300_000
    rows = [(None, "a b", "x", "s", "n", "q", "h"), (1, None, "x", "s", "n", "q", "h"), (2, "", "x", "s", "n", "q", "h"), (3, long, "x", "s", "n", "q", "h"), (4, "A b\tc", "x", "s", "n", "q", "h"), (4, "A b\tc", "x", "s", "n", "q", "h")]
    df = spark.createDataFrame(rows, KIND)
    model = kneser_ney.train(df)
    got = {r["doc_id"]: r for r in kneser_ney.score(df, model).collect()}
    plain = Plain([r[1] for r in rows], 2)
    assert len(got) == 5 and got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[3]["n_tokens"] == 300_001
    assert model.train_tokens == sum(plain.raw.values())
    for r in (rows[0], rows[1], rows[4]):
        assert math.isclose(got[r[0]]["score"], plain.score(r[1]), abs_tol=1e-5)
    assert kneser_ney.score(df.limit(0), model).count() == 0
    none = kneser_ney.train(df.limit(0))
    assert {(r["score"], r["base_score"], r["n_known"]) for r in kneser_ney.score(df, none).collect()} == {(0.0, 0.0, 0)}
    assert kneser_ney.scored(df.limit(0)).count() == 0 and kneser_ney.scored(df).count() == 6
    with pytest.raises(ValueError):
        kneser_ney.train(df, 1)
