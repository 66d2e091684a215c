"""A training-data pipeline over documents: each stage works on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents. Before
each, the executors hand back the memory that the one before it has left unused.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, jaccard_join, mixing, sentencepiece_codec, toxicity
from lodestar.llm.common import release, remove, scratch, shrink, table


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, before which the executors hand back what the one before no longer needs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones, does not reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.dedup(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that similarity of 0.8 on five-word shingles joins, the one with the smallest doc_id."""
    return jaccard_join.representatives(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target takes it."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids."""
    return sentencepiece_codec.encode(docs)


STAGES = [(name, lean(stage)) for name, stage in (("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode_pieces))]

#: Toxicity is a trained model and the codec a search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's folder goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
        release(spark)
    return docs
