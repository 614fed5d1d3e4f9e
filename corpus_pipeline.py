"""From documents to packed training sequences: language, toxicity, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet and read again. All but the last return the columns they were given.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import language, mixing, ngram_join, packing, toxicity
from marginalia.session import scratch_path, ship_code, tune

#: Near duplicates take five words and a similarity of 0.8.
NEAR = ngram_join.Settings(shingle=5, percent=80)


def _ready(stage):
    """Stages run in sessions that somebody else created: the workers get the package, and texts come in small batches."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship_code(tune(spark)), docs, sf_dir)
    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that prevails, go."""
    return language.keep_reliable(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    return ngram_join.one_of_each(docs, NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those past a source's target go."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", _ready(known_language)),
    ("toxicity", _ready(not_toxic)),
    ("near duplicates", _ready(one_per_class)),
    ("mixing", _ready(mixed)),
    ("packing", _ready(packed)),
]

#: SQL cannot express models and tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
