"""Join operators that need more than an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_side(left: DataFrame, key: str, right: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """left with every row of right that has its key on either side, as a left join; an OR would make a nested loop.

    A row of right with the same key on both sides counts once.
    """
    keyed = right.withColumn("_side", F.explode(F.array_distinct(F.array(*sides)))).where(F.col("_side").isNotNull())
    return left.join(keyed, left[key] == F.col("_side"), "left").drop("_side")


def with_ordered_array(left: DataFrame, right: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """left with the sorted distinct values of its rows in right, an empty array if none."""
    lists = right.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))
    kind = right.schema[value].dataType.simpleString()
    return left.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def having(left: DataFrame, right: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """Rows of left with a row in right that satisfies the conditions."""
    for c in conditions:
        right = right.where(c)
    return left.join(right.select(key).distinct(), key, "left_semi")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def latest_only(left: DataFrame, right: DataFrame, key: str, latest: Column) -> DataFrame:
    """Left join where the condition belongs to the join, so rows without a latest one stay."""
    return left.join(right.where(latest), key, "left")


def overlapping(spans: DataFrame, others: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs with equal key whose [start, end) overlap, through cells of `width` so that no group is crossed.

    spans has start, end; others has o_start, o_end. A pair is kept in the cell where its overlap begins.
    """

    def cells(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(b) > F.col(a)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))

    pairs = cells(spans, "start", "end").join(cells(others, "o_start", "o_end"), [key, "_cell"])
    begins = F.floor(F.greatest("start", "o_start") / width) == F.col("_cell")
    return pairs.where((F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end")) & begins).drop("_cell")


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out
