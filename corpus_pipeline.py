"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, mix, tokenise.

Each stage works on the written rows of the one before.  A model and a tokenizer take
part, so the rows have no SQL form.

All stages take null, blank and very long texts, null and repeated ids and further
columns, and give an empty table for an empty one.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from freightlens.llm import decontaminate, minhash_dedup, mixing, token_file, toxicity  # noqa: E402
from freightlens.session import stored  # noqa: E402

REPETITION = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are not predicted toxic, repeats and null ids included; null and empty texts are clean."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows without an id and without words stay."""
    return minhash_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, no source more than ``REPETITION`` times; a null source counts as ''."""
    return mixing.mix(docs, repetition=REPETITION)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per written row its place, tokens and checksum, read back from the files; a null text is its end id alone."""
    return token_file.encoded(docs, token_file.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
