"""Spelling variants against all pairs of words, the hash of runs against zlib, and odd inputs. SQL is compared in test_operators."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import spelling

KIND = "doc_id long, text string, word string, n string, leaf string, form string"


def counted(rows, times=2):
    c = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in c.items() if n >= times and len(w) >= 7}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=10):
    out = {}
    for w, n in words.items():
        ws = [x for x in words if near(w, x)]
        best = min(ws, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        out[w] = (form, n, len(ws), words[form] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, *rest)
    return out


def text(rng, n):
    """Words from few letters, so that near words and anagrams are common; some frequent."""
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 7, 8, 9]))) for _ in range(n)]
    return " ".join(words + [w for w in words[:6] for _ in range(30)] + [w[:-1] + "f" for w in words[:6] for _ in range(3)] + [w[:-1] for w in words[:6] for _ in range(2)])


@pytest.mark.parametrize("leaf", [20_000, 60])
def test_all_pairs(spark, monkeypatch, leaf):
    """One leaf a length, and trees of many leaves, some of which only parts can divide."""
    rng = random.Random(leaf)
    rows = [(i, text(rng, 160)) for i in range(12)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = counted(rows)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(spelling.vocabulary(df), leaf).collect()}
    want = brute(words)
    assert {w for w, x in want.items() if x[3]} == set(got)
    assert all(got[w][0] == want[w][3] for w in got)
    full = {r["word"]: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert full == {w: (f, root, n, k, m) for w, (f, root, n, k, m) in want.items()}
    assert any(f and root != f for f, root, *_ in want.values()) or any(f for f, *_ in want.values())


def test_chains(spark):
    """A root two steps away."""
    rows = [(1, " ".join(["harbours"] * 400 + ["harbourz"] * 40 + ["harbouzz"] * 4))]
    want = brute(counted(rows))
    assert want["harbouzz"][:2] == ("harbourz", "harbours")
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_upper_tree_loses_nothing():
    """Every vector within reach of a query lies in a leaf that the query meets."""
    rng = np.random.default_rng(1)
    letters = rng.choice(np.frombuffer(b"abcdefg", np.uint8), (3000, 8))
    v = spelling.vectors(letters)
    tree = spelling.upper(v[:500], 6, 100)
    own, _ = spelling._own(tree, v)
    met = {(int(i), leaf) for at, leaf, _ in spelling._met(tree, v[:200], 1, 1) for i in at}
    d = v[None, :, :] - v[:200, None, :]
    i, j = np.nonzero((np.maximum(d, 0).sum(2) <= 1) & (np.maximum(-d, 0).sum(2) <= 1))
    assert len(set(own)) > 10 and {(int(a), int(own[b])) for a, b in zip(i, j)} <= met
    assert len(met) < 200 * len(set(own)) / 2  # and it does prune


def test_hash_of_runs():
    data = np.frombuffer("abcdefgh éàüöäïëâ ".encode() + b"x" * 300, np.uint8)
    starts, ends = np.array([0, 9, 26]), np.array([8, 25, 326])
    before = np.array([zlib.crc32(b"1:"), zlib.crc32(b"-22:"), zlib.crc32(b":")], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]
    assert spelling._crcs(data, starts, ends, before).tolist() == want


def test_odd_inputs(spark):
    long = "z" * 70_000
    rows = [(None, "Harbours HARBOURS ÉTALONNÉE étalonnée ÷×harbour", *"abcd"), (1, None, *"abcd"), (2, "", *"abcd"), (3, long, *"abcd"), (4, long + "y", *"abcd"), (4, long + "y", *"abcd"), (5, "short words only", *"abcd")]
    df = spark.createDataFrame(rows, KIND)
    want = brute(counted([r[:2] for r in rows]))
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert got == want and "étalonnée" not in got
    assert spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, factor=1)
