"""Window operators: current runs, chronology, neighbours, discovery ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a run that count as done (fixed values).
DONE = ("COMPLETED", "COMPLETED_WITH_WARNINGS")


def nth_latest(runs: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n-th newest row of each key; order says newest first with a total tie-break."""
    w = Window.partitionBy(*key).orderBy(*order)
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).drop("_n")


def current_runs(runs: DataFrame, key: list[str], status: str, completed: str, run_id: str, done: tuple[str, ...] = DONE, n: int = 1) -> DataFrame:
    """The newest completed run of each key (or the n-th newest)."""
    return nth_latest(runs.where(F.col(status).isin(*done)), key, [F.desc(completed), F.desc(run_id)], n)


def chronology(reports: DataFrame, company: str, order: list[str]) -> DataFrame:
    """chronological_index from 0 and is_latest in each company."""
    w = Window.partitionBy(company).orderBy(*order)
    back = Window.partitionBy(company).orderBy(*[F.desc(c) for c in order])
    return reports.withColumn("chronological_index", (F.row_number().over(w) - 1).cast("long")).withColumn("is_latest", F.row_number().over(back) == 1)


def last_known(value: Column, part: list[str], order: list[str]) -> Column:
    """The value itself or the closest earlier one that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def beside_tables(blocks: DataFrame, part: list[str], order: str, is_table: Column, kept: Column) -> DataFrame:
    """near_table: kept blocks that are the nearest kept one before or after a table."""
    w = Window.partitionBy(*part).orderBy(order)
    at_kept = F.when(kept & ~is_table, F.col(order))
    before = F.last(F.when(is_table, F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(is_table, F.col(order)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    last_kept = F.last(at_kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_kept = F.first(at_kept, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = kept & ~is_table & (F.coalesce(before > F.coalesce(last_kept, F.lit(-1)), F.lit(False)) | F.coalesce(after < F.coalesce(next_kept, F.lit(2**62)), F.lit(False)))
    return blocks.withColumn("near_table", near)


def discovery_ranks(items: DataFrame, scopes: dict[str, list[str]], signal: str, magnitude: str, item: str, top: int = 20) -> DataFrame:
    """Items by signal in each scope: largest magnitude first, ties by id; the percentile counts the whole pool.

    Pools are counted apart, so that each task passes on its best rows alone and a signal with many items isn't gathered.
    """
    out = None
    for scope, keys in scopes.items():
        key = F.concat_ws("|", F.lit(scope), *[F.col(k).cast("string") for k in keys])
        w = Window.partitionBy(signal, *keys).orderBy(F.desc(magnitude), F.col(item).cast("string"))
        best = items.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
        pools = items.groupBy(*[F.col(k).alias(f"_{k}") for k in (signal, *keys)]).agg(F.count("*").alias("pool"))
        ranked = best.join(pools, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (signal, *keys)])).drop(*[f"_{k}" for k in (signal, *keys)])
        ranked = ranked.withColumn("rank_scope", key).withColumn("percentile", 100.0 * (F.col("pool") - F.col("rank") + 1) / F.col("pool"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def best_second_margin(score: Column, part: list[str], order: list[Column]) -> Column:
    """The score less that of the next candidate of the same list; null for the last."""
    return score - F.lead(score).over(Window.partitionBy(*part).orderBy(*order))


#: Rows that the bounds of ranges are taken from, at most about; ranges.
SAMPLED, RANGES = 4_096, 64


def global_rank(df: DataFrame, by: list[str], name: str, descending: bool = False) -> DataFrame:
    """df with its 1-based place in the order of the columns by (no nulls; together a key), without sorting all rows in one task.

    Bounds from a sample by hash cut the order into ranges; rows are ranked within their range and counts of the ranges
    before are added. A wrong bound would only make ranges uneven. df, a narrow table, is persisted, as it is read thrice.
    """
    own = F.struct(*by)
    df = df.persist()
    total = df.count()
    share = min(1.0, SAMPLED / max(total, 1))
    sample = df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(*by).collect()
    ordered = sorted(tuple(r) for r in sample)
    step = max(1, len(ordered) // RANGES)
    bounds = sorted(set(ordered[step::step]))
    if not bounds:
        part = F.lit(0)
    else:
        kinds = [df.schema[c].dataType for c in by]
        part = F.size(F.filter(F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, by, strict=True)]) for b in bounds]), lambda b: b <= own))
    cut = df.withColumn("_range", part)
    sizes = cut.groupBy("_range").count()
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # at most RANGES rows
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    ranked = cut.withColumn("_within", within).join(F.broadcast(before), "_range")
    place = F.col("_before") + F.col("_within")
    return ranked.withColumn(name, (total + 1 - place if descending else place).cast("long")).drop("_range", "_within", "_before")
