"""A corpus pipeline of four stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import bpe, langid, mixing, shingles, simhash
from cellweave.llm.common import cut, drop, table
from cellweave.llm.queries import tokenizer_path

#: SQL has no form of the stages' models and searches; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is ``und``: null texts and texts without a letter."""
    return langid.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of 5-word shingle similarity 0.8 or more, then of SimHash links (4 words, 4 bits)."""
    once = shingles.keep_one(docs)
    out = simhash.keep_one(once, width=4, radius=4)
    drop(once)  # simhash has written its rows
    return out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights 5, 2, 1, repeating."""
    return mixing.mixed(docs, (5, 2, 1), 3)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every row; its ids and the decoded text as digests."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), small=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
