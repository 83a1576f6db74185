"""From raw documents to packed sequences: five stages, each one operator on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. Rows without an id pass every filter but the
first; repeated rows (one id and text) leave the second stage as one; null and empty
texts stay as they are where the classifier keeps them; texts of any length pass
whole; empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import neardups, packing, quality, secrets, substrings
from shelfmark.llm._text import fold, table, written


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays; of repeated rows, one."""
    return neardups.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier in the corpus are cut out."""
    return _measured(substrings.deduplicated(docs)).select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _measured(secrets.redact(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("near_duplicates", distinct), ("substrings", unrepeated), ("secrets", redacted), ("packing", packed)]

#: A trained classifier decides the first stage, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
