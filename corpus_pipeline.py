"""The corpus pipeline: quality filter, line dedup, near-copy removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the
next stage's docs; a stage's table goes once its successor is written. All but the last return the columns of documents.

Defined cases: a null text counts as empty in every stage and stays null up to the last; null ids, sources and languages are values
of their own; rows that repeat an id are told apart by their texts, and rows repeated with id and text stay or go together until the
mix, which repeats rows; ties go to the smaller id; extra columns pass through all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.llm import bpe, linededup, mixing, ngramjoin, quality
from docwright.session import dropped, own_name, saved, small_batches, table


def stage(make: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's Python workers outlive it: each stage takes texts in small batches, so that what they hold doesn't mount."""

    @functools.wraps(make)
    def made(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return make(spark, docs, sf_dir)

    return made


@stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.reject_low_quality(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; a null text stays null."""
    return linededup.without_repeats(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingle similarity of 0.8 or more the smallest id stays."""
    return ngramjoin.keep_one(docs, n=5, percent=80)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each time a document is taken; the quality classifier's score weighs it."""
    score, number = own_name(docs, "_score"), own_name(docs, "_number")
    scored = saved(quality.with_score(docs, table(spark, sf_dir, "labels"), score).withColumn(number, F.monotonically_increasing_id()), "scored")
    out = mixing.mix(scored, F.col(score), number).select(*docs.columns)
    out._reads = (scored,)
    return out


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, bpe.vocabulary(), keep_words=False)  # the next run's stages find the same workers


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mixing", mixture), ("bpe", tokens)]
#: Training a classifier and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, make in STAGES[:-1]:
        made = make(spark, docs, sf_dir)
        before, docs = docs, saved(made, f"stage-{name}")
        dropped(before, *getattr(made, "_reads", ()))
    return STAGES[-1][1](spark, docs, sf_dir)
