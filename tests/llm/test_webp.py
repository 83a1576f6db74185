"""The stored form: which transforms it has, that both readers invert them, and the query's columns against the payloads themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfmark.llm import webp

SF = "/root/testdata/sf0.001"


def payloads():
    r = random.Random(4)
    texts = ["", "a" * 20000, "ab\n" * 900, "é" * 700, "".join(r.choice("abc déf\n") for _ in range(9000)), "the same the same " * 99, "".join(chr(r.randrange(32, 0x2000)) for _ in range(3000)), "x"]
    lines = "".join(f"{i % 7} of a line that comes again in rows of its own width, five hundred".ljust(144 * 4, ".") for i in range(40))
    return [webp.padded(t) for t in [*texts, lines]] + [bytes(r.randrange(256) for _ in range(576 * 3)), bytes(range(64, 80)) * 36 * 30]


def test_forms():
    """Palettes of every packing, both predictors with cross-colour, and no transform; the step-wise reader gives what the reader of record gives."""
    r = random.Random(1)
    some = payloads()
    for n in (1, 2, 3, 4, 5, 16, 17):
        colours = [r.randbytes(4) for _ in range(n)]
        some.append(b"".join(colours[i % n] for i in range(144 * 3)))
    noise = np.random.default_rng(3).choice(np.array([0, 1, 255], np.uint8), 576 * 2)
    some.append(noise.tobytes())  # bytes that are small as they stand
    media = webp.write(some)
    streams = [next(webp.chunks(m)) for m in media]
    forms = [webp._form_of(s) for s in streams]
    assert all(forms) and {f[0] for f in forms} == {webp.INDEX, webp.RESIDUAL, webp.PLAIN}
    assert {f[3][0] for f in forms if f[0] is webp.RESIDUAL} == {1, 2} and any(any(f[3][1]) for f in forms if f[0] is webp.RESIDUAL)
    assert {len(f[3][0]) for f in forms if f[0] is webp.INDEX} >= {1, 2, 3, 4, 5, 16}
    assert webp.decode_many(streams) == some
    assert [webp.decode_bits(s)[0].astype(">u4").tobytes() for s in streams] == some
    assert media == [webp.write([p])[0] for p in some]
    order = list(range(len(some)))
    r.shuffle(order)
    assert webp.decode_many([streams[i] for i in order]) == [some[i] for i in order]


def test_rule_takes_the_smaller_residuals():
    for p in payloads():
        form, _, _, _, _ = webp.formed(p)
        b = webp._bytes_of(np.frombuffer(p, ">u4").astype(np.uint32))
        sums = {0: webp._small(b)} | {m: webp._small(webp._differences(b, m)) for m in (1, 2)}
        few = len(np.unique(np.frombuffer(p, ">u4"))) <= webp.COLOURS
        assert form is (webp.INDEX if few else webp.PLAIN if min(sums[1], sums[2]) >= sums[0] else webp.RESIDUAL)
        for m in (1, 2):
            assert (webp._sums(webp._differences(b, m), m) == b).all()


def test_strangers_go_to_the_other_reader():
    """A stream with a change in its header isn't taken for the writer's own, and one that is cut is an error."""
    stream = next(webp.chunks(webp.write([webp.padded("some text that is no palette, and long enough " * 9)])[0]))
    assert webp._form_of(stream)
    for bit in (41, 43, 60, 150, 200):
        other = bytearray(stream)
        other[bit >> 3] ^= 1 << (bit & 7)
        mine = webp._form_of(bytes(other))
        assert mine is None or mine[3] != webp._form_of(stream)[3]
    with pytest.raises((ValueError, IndexError)):
        webp.decode_many([stream[: len(stream) // 2]])


def test_query_against_the_payloads(spark):
    """Every column of the query but the feature is told from the text alone, and the media is read by the reader of record."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 576), (10**6 + 3, "y" * (576 * webp.ROWS + 1))], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.unionByName(odd).collect()}
    got = {r["doc_id"]: r for r in webp.stored(docs.unionByName(odd)).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        if len(pay) < 40_000:
            media = webp.write([pay])[0]
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            image = webp.decode(media)
            assert image.tobytes() == pay and r["feature"] == ":".join(str(x) for x in (len(image), *(image.reshape(-1, 4).sum(0, dtype=np.int64) * 1000 // (len(pay) // 4)).tolist()))
