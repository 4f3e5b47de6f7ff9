"""A training corpus from ``documents``: language, near duplicates, benchmark passages, mixture, token rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language, mixing, near_dedup, packing, phrase_index, storage
from logloom.session import delete_path, scratch_path

#: Least language score of a document that stays: what has no letter, or resembles no language, goes.
LEAST_SCORE = 0.02

#: Tables the stages before have written and nothing reads any more.
_left: list[str] = []


def _stage(fn: Callable) -> Callable:
    """A stage starts when the result before it has been written, so what that needed is deleted."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.release(spark, _left)
        storage.small_batches(spark)
        with storage.noted(_left):
            return fn(spark, docs, sf_dir)
    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones among them.

    Texts that are null or without a letter go, whatever else a row holds; null ids and languages teach nothing.
    """
    profiles = language.fit(docs.filter(language.remainder(F.col("doc_id"), 3) != 1))
    return language.accepted(docs, profiles, LEAST_SCORE)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Texts without words resemble nothing and stay; of rows that repeat an id and text one stays, rows without an id
    are judged by their own text.
    """
    return near_dedup.without_near_duplicates(docs)


@_stage
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item, nor a shorter item as a whole.

    Null and empty texts hold nothing and stay, and an empty benchmark takes nothing out; repeated rows share their lot.
    """
    return phrase_index.decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate asks for.

    Documents without words count nothing towards a target and are repeated like others of their source; a null
    source is a source. Repeated rows draw alike, rows without an id share one draw.
    """
    return mixing.mixture(docs)


@_stage
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids. A null or empty text is one end token; a document longer than a row is cut; no row, no output."""
    return packing.packed(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL cannot express the profiles, the MinHash links or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed rows."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
