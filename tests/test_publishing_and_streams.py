"""Publications as a whole or not at all, and the streaming forms over files that arrive in turn."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.streaming import incremental


def test_a_failed_build_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = spark.range(3), spark.range(4)
    sinks.publish({"a": a, "b": b}, root, "p1")
    assert sinks.published(spark, root, "p1") and not sinks.published(spark, root, "p2")
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish({"a": spark.range(9), "b": broken}, root, "p1")
    assert sinks.published(spark, root, "p1") and [spark.read.parquet(f"{root}/{x}").count() for x in "ab"] == [3, 4]
    sinks.publish({"a": spark.range(9), "b": b}, root, "p1")
    sinks.publish({"a": a, "b": b}, root, "p2")
    state = spark.createDataFrame([("p1", "ACTIVE", None), ("p2", "READY", None)], sinks.STATE)
    assert sinks.current(spark, root, "a", state).count() == 9 and spark.read.parquet(f"{root}/a").count() == 12
    assert not (tmp_path / "_aside" / "p1").exists()


def test_daily_counts_of_a_stream(spark, tmp_path):
    schema = "key string, ts timestamp"

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        counts = incremental.daily_counts(stream, ["key"], "ts")
        q = counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    arrive(1, [("a", day(1)), ("a", day(1, 5)), ("b", day(2))])
    run()
    arrive(2, [("a", day(20)), ("a", day(1, 7))])
    run()
    arrive(3, [("a", day(1, 9)), ("b", day(21))])
    run()
    got = sorted((r.day.day, r.key, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a", 3), (2, "b", 1)]


def test_micro_batches_skip_what_is_done(spark, tmp_path):
    done, seen = [], []

    def finished():
        return spark.createDataFrame(done, "item string, fingerprint string")

    def process(batch):
        items = sorted(r.item for r in batch.collect())
        seen.append(items)
        done.extend((i, "f1") for i in items)

    for n, items in enumerate((["x", "y"], ["y", "z"], ["x"])):
        spark.createDataFrame([(i,) for i in items], "item string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("item string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        incremental.each_batch(stream, finished, ["item"], "f1", process, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [["x", "y"], ["z"], []]
