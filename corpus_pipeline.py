"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret removal and packing, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result and rereads it for the next.
All stages but the last return the columns of documents. The stages that run Python bound the bytes of an Arrow batch in
their session, unless it names a bound itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import written
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.language import with_language
from tidemark.llm.near_dedup import deduplicated
from tidemark.llm.packing import packed
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.secrets import redacted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of rows that a Python worker is handed at once, about; a larger row goes alone. Spark's own bound is 64 MiB or
#: 10,000 rows, of which executor and worker hold several copies, and the executor's allocator keeps what it once took.
BATCH_BYTES = 2 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(stage: Stage) -> Stage:
    """stage with batches of BATCH_BYTES. The session keeps the bound, since what a stage returns is computed later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _BOUND not in spark.conf.getAll:
            spark.conf.set(_BOUND, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, since null or without a letter, go."""
    return with_language(docs)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return deduplicated(docs, percent=80)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window near a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and n_chars anew."""
    return redacted(docs)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents that are left, with their places in sequences."""
    return packed(docs, tokenizer_path)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Tokenisation and learned models are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
