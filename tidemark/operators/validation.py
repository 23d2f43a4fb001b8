"""Integrity checks as one report, contiguity, and the findings shown first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't among the parent's; a null key isn't an orphan."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def not_contiguous(df: DataFrame, key: list[str], index: str, first: int = 0) -> DataFrame:
    """Keys whose indices aren't first, first + 1, ... without gap or repetition."""
    agg = df.groupBy(*key).agg(F.min(index).alias("_a"), F.max(index).alias("_b"), F.count("*").alias("_n"), F.countDistinct(index).alias("_d"))
    return agg.where(~((F.col("_a") == first) & (F.col("_b") == F.col("_n") + first - 1) & (F.col("_d") == F.col("_n"))))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, failures): the rows that each check finds wrong."""
    counted = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), "failures") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def summary_json(report_: DataFrame) -> DataFrame:
    """One row: whether all passed, how many checks ran, and the names that failed, as JSON."""
    failed = F.sort_array(F.collect_list(F.when(F.col("failures") > 0, F.col("check_name"))))
    agg = report_.agg((F.sum("failures") == 0).alias("passed"), F.count("*").alias("checks_run"), failed.alias("failures"))
    return agg.select(F.to_json(F.struct("passed", "checks_run", "failures")).alias("summary"))


def top_findings(measures: DataFrame, key: str, epsilons: dict[str, float]) -> DataFrame:
    """The three largest magnitudes beyond their epsilon, ties in the order given; slots without one are null."""
    items: list[Column] = [F.struct(F.lit(i).alias("o"), F.lit(k).alias("k"), F.col(k).cast("double").alias("v"), F.lit(e).alias("e")) for i, (k, e) in enumerate(epsilons.items())]
    long = measures.select(key, F.explode(F.array(*items)).alias("s")).where(F.abs("s.v") > F.col("s.e"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("s.v"), 9)), "s.o"))
    ranked = long.select(key, F.col("s.k").alias("k"), n.alias("n")).where("n <= 3")
    slots = ranked.groupBy(key).agg(*[F.max(F.when(F.col("n") == i, F.col("k"))).alias(c) for i, c in ((1, "first_finding"), (2, "second_finding"), (3, "third_finding"))])
    return measures.select(key).join(slots, key, "left")
