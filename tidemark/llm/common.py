"""Shared plumbing of the corpus operators: lineage cuts, whole groups out of sorted partitions, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Used only where the session names no shared folder (single-machine tests).
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master where it is unset."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_folder


#: Rows of a narrow table (ids and a few numbers) up to which it is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written narrow table, with a broadcast hint if its counted rows are within the bound."""
    bound = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Narrow rows of a part of a table that written() is told the size of.
PART_ROWS = 250_000


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again, so that a lost executor costs a reread.

    rows: a bound of df's rows if they are narrow; a small table is then made and written in few parts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    (df if rows is None else df.coalesce(max(1, -(-rows // PART_ROWS)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads, once what was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._tidemark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, which gives free memory back to the system after each task; a reused worker would keep its peak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_group(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: StructType | str, rows: int = 4096, order: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Apply fn to tables that hold whole groups of key, many small groups at once.

    Callers bound the size of a group; a table has about `rows` rows, or one group. parts: tasks, where the work of a
    group isn't told by its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, rows):
            yield from fn(table)

    return (df.repartition(key) if parts is None else df.repartition(parts, key)).sortWithinPartitions(key, *order).mapInArrow(lean(run), schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks()
        last = keys[-1]
        inside = pc.index(pc.equal(keys, last), True).as_py() if last.is_valid else pc.index(pc.is_null(keys), True).as_py()
        if inside:
            yield table.slice(0, inside)
            rest = table.slice(inside).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        else:
            held = table.combine_chunks().to_batches()
    if count:
        yield pa.Table.from_batches(held)


def aside(df: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(df with all but the kept columns renamed, the way back), so that an operator's own columns never clash with them."""
    names = list(df.columns)
    own = {c: c if c in kept else f"_aside{i}" for i, c in enumerate(names)}
    return df.toDF(*own.values()), lambda out: out.select(*[F.col(own[c]) for c in names]).toDF(*names)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) for every vertex of edges (a long, b long); component is the smallest id reachable.

    Alternating large-star and small-star steps: each is one pre-aggregated minimum and one equi-join that adaptive
    execution may split, so a hub with most of the edges isn't gathered in one task. Stops when a round changes nothing.
    """
    now = written(_canonical(edges.select("a", "b")), tag)
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now, mark[0])), tag, mark[0])
        after = _mark(now)
        if after == mark:
            break
        mark = after
    labels = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return labels.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller id."""
    return edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", 2 * rows)
    return written(_canonical(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "star", rows)


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return _canonical(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
