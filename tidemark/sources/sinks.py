"""Sinks: delimited files, publications as partitions, and the one-row state that names the active one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "publication_id string, status string, completed_at timestamp"


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Header and empty cells for null; as many files as partitions unless a number is given."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def publish(tables: dict[str, DataFrame], root: str, publication_id: str) -> None:
    """One partition of each table for a publication, seen as a whole or not at all.

    All tables are written aside first; only when every one is complete are they put in place, each by a rename, and the
    mark _PUBLISHED comes last. A failure before that leaves an earlier build of the same publication as it was; a failure
    between the renames leaves no mark, and the rebuild replaces what is there. Readers ask `published` for the mark.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/_aside/{publication_id}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = path(f"{root}/_PUBLISHED/{publication_id}")
    fs.delete(mark, True)
    for name in tables:
        to = path(f"{root}/{name}/publication_id={publication_id}")
        fs.delete(to, True)
        fs.mkdirs(to.getParent())
        if not fs.rename(path(f"{root}/_aside/{publication_id}/{name}"), to):
            raise OSError(f"{name} of publication {publication_id} can't be put in place")
    fs.delete(path(f"{root}/_aside/{publication_id}"), True)
    fs.create(mark, True).close()


def published(spark: SparkSession, root: str, publication_id: str) -> bool:
    """Whether every table of a publication is in place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return bool(path(root).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{root}/_PUBLISHED/{publication_id}")))


def activated(state: DataFrame, publication_id: str) -> DataFrame:
    """The state after activating a publication: it must be READY; the one that was ACTIVE is SUPERSEDED."""
    ready = F.max(F.when((F.col("publication_id") == publication_id) & (F.col("status") == "READY"), F.lit(True))).over(Window.partitionBy(F.lit(1)))
    to = F.when(F.col("publication_id") == publication_id, F.lit("ACTIVE")).when(F.col("status") == "ACTIVE", F.lit("SUPERSEDED")).otherwise(F.col("status"))
    status = F.when(ready, to).otherwise(F.raise_error(F.lit(f"publication {publication_id} is not ready")))
    return state.withColumn("status", status)


def removable(state: DataFrame, keep: int = 2) -> DataFrame:
    """Publications beyond the active one and the newest `keep` successful ones."""
    done = state.where(F.col("status").isin("READY", "SUPERSEDED"))
    n = F.row_number().over(Window.orderBy(F.desc_nulls_last("completed_at"), F.desc("publication_id")))
    kept = done.withColumn("_n", n).where(F.col("_n") <= keep).select("publication_id")
    return state.where("status <> 'ACTIVE'").join(kept, "publication_id", "left_anti")


def current(spark: SparkSession, root: str, name: str, state: DataFrame) -> DataFrame:
    """A table's rows of the active publication; the partition filter prunes all others."""
    active = state.where("status = 'ACTIVE'").select("publication_id").limit(1).collect()
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.where(F.col("publication_id") == (active[0][0] if active else ""))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out."""
    df.write.mode("overwrite").json(path)


def distinct_stores(source: str, target: str, allow_same: bool = False) -> None:
    """Raise if source and target are one store, unless that is wanted."""
    if not allow_same and source.rstrip("/").removeprefix("file:") == target.rstrip("/").removeprefix("file:"):
        raise ValueError("source and target are the same store")


def same_contract(given: dict, expected: dict) -> None:
    """Raise if an embedding's model, revision or dimension isn't the expected one."""
    wrong = [k for k in ("model", "revision", "dimension") if given.get(k) != expected.get(k)]
    if wrong:
        raise ValueError("embedding contract differs in " + ", ".join(wrong))
