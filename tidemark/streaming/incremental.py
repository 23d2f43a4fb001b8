"""Incremental forms: skip what a fingerprint has done, and daily counters over an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: list[str], fingerprint: str, force: bool = False) -> DataFrame:
    """Items without a finished run for the same key and fingerprint."""
    items = items.withColumn("fingerprint", F.lit(fingerprint))
    return items if force else items.join(done.select(*key, "fingerprint").distinct(), [*key, "fingerprint"], "left_anti")


def outcomes(df: DataFrame, value: Column, problem: Column) -> DataFrame:
    """value where there is no problem, and a status column in place of an exception."""
    return df.withColumn("status", F.when(problem.isNull(), F.lit("COMPLETED")).otherwise(F.lit("FAILED"))).withColumn("error", problem).withColumn("value", F.when(problem.isNull(), value))


def daily_counts(events: DataFrame, key: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """Events a key and day; works on a stream, where days older than the watermark are closed and forgotten."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), *key).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), *key, "n")


def each_batch(stream: DataFrame, done: Callable[[], DataFrame], key: list[str], fingerprint: str, process: Callable[[DataFrame], None], checkpoint: str):
    """Run process over what is pending in every micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, _: process(pending(batch, done(), key, fingerprint))).option("checkpointLocation", checkpoint)
