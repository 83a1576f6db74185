"""Token alignment against a walk over both token lists, one text at a time, and odd inputs."""

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, digest string, copies string, n_a string, pairs string"


def byte_of():
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def brute():
    a, b, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        names = {i: s for s, i in json.load(f)["model"]["vocab"].items()}

    def tokens(text):
        if not text:
            return [], []
        ta = [(i, bytes(byte[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(i, bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace("▁", " ").encode()) for i in b.encode(text) for s in [b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (ta, tb) if b"".join(x for _, x in ta) == want == b"".join(x for _, x in tb) else ([], [])

    def spans(ts):
        at, out = 0, []
        for i, x in ts:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(rows):
        links, out, total = {}, {}, Counter()
        for key, text in rows:
            ta, tb = map(spans, tokens(text))
            links[key] = [(i, j) for i, s, e in ta for j, u, v in tb if s < v and u < e] if len(ta) * len(tb) < 200_000 else sweep(ta, tb)
            total.update(links[key])
            cuts = sorted({e for *_, e in ta} & {e for *_, e in tb})
            groups, low = [], 0
            for c in cuts:
                groups.append(",".join(str(i) for i, s, e in ta if low < e <= c) + "|" + ",".join(str(i) for i, s, e in tb if low < e <= c)) if len(ta) < 3000 else None
                low = c
            out[key] = [len(ta), len(tb), len(cuts), groups]
        best = {}
        for (_, j), n in total.items():
            best[j] = max(best.get(j, 0), n)
        for key, (na, nb, ng, groups) in out.items():
            ls = links[key]
            out[key] = (na, nb, ng, len(ls), sum(total[x] == best[x[1]] for x in ls), sum(total[x] for x in ls), hashlib.sha256(";".join(groups).encode()).hexdigest() if na and na < 3000 else "")
        return out

    def sweep(ta, tb):
        x = y = 0
        out = []
        while x < len(ta) and y < len(tb):
            out.append((ta[x][0], tb[y][0]))
            e, v = ta[x][2], tb[y][2]
            x, y = x + (e <= v), y + (v <= e)
        return out

    return run


def _rows(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [(r["doc_id"], tuple(r[n] for n in names)) for r in alignment.aligned_documents(df, A, B).collect()]


def test_documents(spark, brute):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = dict(_rows(docs))
    assert len(got) == len(want)
    for key, w in want.items():
        assert got[key][:6] == w[:6]
        assert w[0] >= 3000 or got[key][6] == w[6]


def test_odd_inputs(spark, brute):
    """Nulls, empty texts, copies, special strings, bytes that only one side spells, an underline that B takes for a space, long runs, no rows."""
    texts = ["a text", None, "", "a text", "<|endoftext|> <s> </s> <unk> <0x0A> x", "né ï 😀\t\n\x00 tab", "low▁line", "  two  spaces ", " " * 3000, "x" * 5000, "ﬁ Å Ⅷ", "a text", "ab" * 70_000]
    rows = [(i if i != 4 else None, t, *"xyzw") for i, t in enumerate(texts)] + [(0, "a text", *"xyzw")]
    df = spark.createDataFrame(rows, KIND)
    want = brute(list(enumerate(r[1] for r in rows)))
    got = sorted(_rows(df), key=repr)
    assert [(k, g[:6]) for k, g in got] == sorted(((rows[i][0], w[:6]) for i, w in want.items()), key=repr)
    same = sorted((rows[i][0], w[6]) for i, w in want.items() if w[0] < 3000 and rows[i][0] is not None)
    assert same == sorted((k, g[6]) for k, g in got if k is not None and g[0] < 3000)
    told = dict(got)
    assert told[1] == told[2] == told[6] == (0, 0, 0, 0, 0, 0, "") and told[5][0] > 0
    assert _rows(df.limit(0)) == []


def test_spans_give_the_bytes_back():
    a, b = alignment.sides(A, B)
    for text in ("plain words", "né ï 😀"):
        for side in (a, b):
            import numpy as np

            assert side.joined(np.array(side.encode([text])[0])).tobytes() == (" " + text).encode()
