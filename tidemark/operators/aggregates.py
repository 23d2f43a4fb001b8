"""Aggregates, facets, samples and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut points of the magnitude bands (fixed values).
CUTS = {"p50": 0.50, "p79": 0.79, "p94": 0.94}


def bands(df: DataFrame, keys: list[str], magnitude: Column) -> DataFrame:
    """Interpolated cut points of a magnitude for each key."""
    return df.groupBy(*keys).agg(*[F.percentile(magnitude, F.lit(p)).alias(c) for c, p in CUTS.items()])


def signed_label(v: Column) -> Column:
    """Band and direction of v beside columns p50, p79 and p94; a bound belongs to the smaller band."""
    m = F.abs(v)
    size = F.when(m <= F.col("p50"), F.lit("small")).when(m <= F.col("p79"), F.lit("moderate")).when(m <= F.col("p94"), F.lit("large")).otherwise(F.lit("very large"))
    return F.concat(size, F.when(v > 0, F.lit(" increase")).when(v < 0, F.lit(" decrease")).otherwise(F.lit("")))


def facets(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(dimension, value, n) of several columns, each row read once."""
    tagged = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()])
    return df.select(F.explode(tagged).alias("f")).groupBy("f.dimension", "f.value").agg(F.count("*").alias("n"))


def composition(df: DataFrame, key: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """(key, status, n, share) for every status, zero where a key has none of it; share is null for keys without any."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(f"_{i}") for i, s in enumerate(statuses)])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"_{i}").alias("n")) for i, s in enumerate(statuses)])
    total = sum((F.col(f"_{i}") for i in range(1, len(statuses))), F.col("_0"))
    out = counts.select(key, F.explode(rows).alias("r"), total.alias("total"))
    return out.select(key, "r.status", "r.n", F.when(F.col("total") > 0, F.col("r.n") / F.col("total")).alias("share"))


def capped_count(df: DataFrame, cap: int) -> DataFrame:
    """(n, more): rows up to cap and whether there are more; reads no further than cap + 1 rows."""
    n = F.count("*")
    return df.select(F.lit(1)).limit(cap + 1).agg(F.least(n, F.lit(cap)).alias("n"), (n > cap).alias("more"))


def summary(df: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """(metric, n, least, median, most, mean) of the values that aren't null."""
    long = df.unpivot([], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "v")
    agg = long.groupBy("metric").agg(F.count("v").alias("n"), *[F.round(f("v"), digits).alias(c) for c, f in (("least", F.min), ("median", F.median), ("most", F.max), ("mean", F.avg))])
    return agg


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of df in a total order, with the position of each row. A bounded top-k; only the page is numbered."""
    start = (number - 1) * size
    rows = df.orderBy(*order).limit(start + size).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return rows.where(F.col("position") > start)


def page_state(total: int, number: int, size: int = 50) -> dict[str, int | bool]:
    """Clamped page number, pages, and whether there is one before and after."""
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return {"page": number, "pages": pages, "has_previous": number > 1, "has_next": number < pages}


def tails(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n lowest and n highest rows of each key; a row that is both is low."""
    w = Window.partitionBy(*keys)
    low = F.row_number().over(w.orderBy(*order))
    high = F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))
    out = df.withColumn("_low", low).withColumn("_high", high).where((F.col("_low") <= n) | (F.col("_high") <= n))
    return out.withColumn("tail", F.when(F.col("_low") <= n, F.lit("low")).otherwise(F.lit("high"))).drop("_low", "_high")


def seeded_sample(df: DataFrame, keys: list[str], row_id: Column, seed: int, n: int) -> DataFrame:
    """n rows of each key, the same for a seed whatever the partitioning."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), row_id), 256)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def narrative(blocks: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Texts of each key in order, joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n\n").alias("narrative"))
