"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from labelled texts.
A text is compressed whole with every dictionary; the smallest result names its
language. The score is a logistic function of the relative margin between the
smallest and the second smallest size; narrow margins are marked `rejected`.

What is learned: at most `PER_LANGUAGE` labelled documents of each language (a
documented bound), taken by the smallest hash of the id in each of `PER_LANGUAGE`
hash buckets, and from them at most `DICTIONARY` bytes, at places that follow from the
hash. More than `LANGUAGES` languages are an error, not cut. A text is compressed
once for each language, so the time grows with their number.

Defined results: a null text, or one without any letter, is `und` with score 0
and rejected; with nothing to learn from, all texts are; repeated rows give
repeated rows; extra columns are ignored; ties go to the first language by
name, with score 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm._text import documents, fold, slices

PER_LANGUAGE = 256
LANGUAGES = 500
DICTIONARY = 112 << 10
LEVEL = 3
#: Relative margin at which the score is 0.73, and the one under which a prediction is rejected.
SCALE, NARROW = 0.02, 0.01
_MARKS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case words with single spaces, runs of one word once: case, digits, marks and repetition tell no language."""
    return " ".join(w for w, _ in groupby(_MARKS.split(text.lower()))).encode("utf-8", "surrogatepass")


def learn(df: DataFrame, train: Column, per_language: int = PER_LANGUAGE, most: int = DICTIONARY, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the rows that `train` admits."""
    labelled = documents(df, "doc_id", "lang", "text").where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    keyed = labelled.withColumn("h", F.xxhash64("doc_id", "lang"))
    chosen = keyed.where(F.length("text") > 0).groupBy("lang", F.pmod("h", F.lit(per_language)).alias("bucket")).agg(F.min("h").alias("h"))
    few = chosen.select("lang", "h").limit(per_language * languages + 1).collect()
    if len({r["lang"] for r in few}) > languages or len(few) > per_language * languages:
        raise ValueError(f"more than {languages} languages to learn: raise `languages`")
    few = df.sparkSession.createDataFrame(few, chosen.select("lang", "h").schema)
    texts: dict[str, list[tuple[int, str]]] = {}
    share = most // 16  # no single text fills a dictionary; the place of the part that is taken follows from the hash
    start = F.pmod(F.shiftright("h", 8), F.greatest(F.length("text") - share + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = keyed.join(F.broadcast(few), ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", start, F.lit(share)).alias("text")).distinct().collect()
    for r in rows:
        texts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang, got in sorted(texts.items()):
        got.sort()
        each = max(256, most // len(got))
        parts = []
        for h, t in got:
            raw = plain(t)
            at = h % max(1, len(raw) - each + 1)
            parts.append(raw[at : at + each])
        out[lang] = b"\n".join(parts)[:most]
    return out


def predict(df: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every whole text."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for n in names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False))
        for part in slices(batches):
            langs, margins = [], []
            for text in part.column("text").to_pylist():
                if not text or not names or not any(map(str.isalpha, text)):
                    langs.append("und")
                    margins.append(None)
                    continue
                raw = plain(text)
                sizes = [len(c.compress(raw)) for c in coders]
                best = int(np.argmin(sizes))
                rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                langs.append(names[best])
                margins.append((rest - sizes[best]) / rest)
            m = np.array([0.0 if x is None else x for x in margins])
            known = np.array([x is not None for x in margins], bool)
            score = np.where(known, 1 / (1 + np.exp(-m / SCALE)), 0.0)
            columns = [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(m, pa.float64()), pa.array(~known | (m < NARROW))]
            yield pa.record_batch(columns, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def identify(df: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from all folds but one and predict every row: the contract of op4."""
    dictionaries = learn(df, fold("doc_id", folds) != held_out)
    out = predict(df, dictionaries)
    return out.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", "margin", "rejected")
