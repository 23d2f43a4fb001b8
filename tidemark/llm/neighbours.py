"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample; every vector is indexed in the list of its nearest centroid and, near a
boundary, also in the lists of others almost as near, up to COPIES. A query walks an in-memory graph of the centroids and
takes the lists whose distance is within RATIO of the nearest, and more until they hold enough vectors. The graph has at
most LISTS centroids; a list of more than SPLIT vectors is split again around centroids of its own, in blocks and as
often as needed, so the number of lists grows with the rows and their length doesn't. What is still long after LEVELS
splits is scored in bounded blocks of vectors against bounded blocks of queries, so no list is gathered in one task.

Nearness is the largest inner product. For vectors of any norm it becomes a distance by one more component that fills
each vector up to the largest norm; scores are inner products of the original vectors in double precision.

Of vectors that are equal in every component only the first K rows of an id and the first 2 K rows by id can be among K
nearest, since ties go to the smaller id and a query leaves out one id; the others are left out of the lists (they are
still queries). Vectors that are null, zero, of another than the most common dimension, or that hold null or non-finite
components take no part. Null ids take no part. Rows that repeat an id are candidates each, equal or not; a query leaves
out all rows of its own id, and an id that is asked in several different vectors is answered from all of them together.
Fewer candidates than K are all returned; without any, nothing is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import by_group, lean, small_side, written
from .kernels import stream

#: Vectors that centroids are fitted on and that bound the scores of results from below, lists at most, vectors a list on average, rounds of fitting.
SAMPLE, LISTS, AVERAGE, ROUNDS = 20_000, 2048, 96, 8
#: Copies of a boundary vector, how much farther its other lists may be.
COPIES, NEAR = 4, 1.08
#: How much farther than the nearest a searched list may be; vectors that the lists hold at least, per result.
RATIO, ENOUGH = 1.16, 40
#: Vectors and queries of a block.
BLOCK, BATCH = 8192, 2048
#: Vectors of a list beyond which it is split, of a part on average, parts of a split at most, splits on top of each other.
SPLIT, PART, PARTS, LEVELS = 16_384, 1024, 64, 6
#: Sampled vectors that the centroids of a split are fitted on; copies of a boundary vector and least parts of a query in it.
FITTED, HALVES, LEAST = 4096, 2, 4
#: Neighbours of a centroid in the graph.
DEGREE = 16


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spread(v: np.ndarray, norm: float) -> np.ndarray:
    """v with the component that makes every norm the same."""
    rest = np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0.0))
    return np.column_stack([v, rest])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0.0)


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """n centroids by Lloyd's rounds; an empty one restarts from a vector of the largest cluster, which evens out sizes."""
    n = max(1, min(n, len(np.unique(sample, axis=0))))
    order = np.argsort(stream(41, len(sample)))
    centre = sample[order[:n]].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_squared(sample[i : i + 2048], centre).argmin(axis=1) for i in range(0, len(sample), 2048)])
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        full = size > 0
        centre[full] = total[full] / size[full, None]
        for k in np.flatnonzero(~full):
            big = int(size.argmax())
            inside = np.flatnonzero(own == big)
            centre[k] = sample[inside[len(inside) // 2]]
            own[inside[: len(inside) // 2]] = k
            size[k], size[big] = len(inside) // 2, len(inside) - len(inside) // 2
    return centre


class Graph:
    """Centroids joined to their nearest and, through hubs, to far ones; walked from the hubs towards a query."""

    def __init__(self, centre: np.ndarray) -> None:
        self.centre = centre
        n = len(centre)
        self.hubs = np.sort(np.argsort(stream(42, n))[: max(1, int(np.sqrt(n)))])
        near = np.concatenate([np.argsort(_squared(centre[i : i + 512], centre), axis=1)[:, : DEGREE + 1] for i in range(0, n, 512)])
        links: list[set[int]] = [set() for _ in range(n)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if j != i:
                    links[i].add(j), links[j].add(i)
        hub = self.hubs[_squared(centre, centre[self.hubs]).argmin(axis=1)]
        for i, h in enumerate(hub.tolist()):
            if h != i:
                links[i].add(h), links[h].add(i)
        self.links = [np.array(sorted(x), np.int64) for x in links]

    def search(self, q: np.ndarray, ratio: float, sizes: np.ndarray, enough: int) -> np.ndarray:
        """Lists within ratio of the nearest found, and further ones until they hold enough vectors."""
        distance = np.full(len(self.centre), np.inf)

        def visit(nodes: np.ndarray) -> None:
            distance[nodes] = np.sqrt(np.maximum(((self.centre[nodes] - q) ** 2).sum(axis=1), 0.0))

        visit(self.hubs)
        expanded = np.zeros(len(distance), bool)
        reach = ratio
        while True:
            known = np.flatnonzero(np.isfinite(distance))
            limit = max(reach * distance[known].min(), np.partition(distance[known], min(7, len(known) - 1))[min(7, len(known) - 1)])
            todo = known[(distance[known] <= limit) & ~expanded[known]]
            if len(todo):
                expanded[todo] = True
                around = np.unique(np.concatenate([self.links[i] for i in todo.tolist()]) if len(todo) else todo)
                around = around[~np.isfinite(distance[around])]
                if len(around):
                    visit(around)
                continue
            chosen = known[distance[known] <= reach * distance[known].min()]
            if sizes[chosen].sum() >= enough or len(chosen) == len(distance):
                return chosen
            if len(known) == len(distance):
                order = known[np.argsort(distance[known], kind="stable")]
                return order[: int(np.searchsorted(np.cumsum(sizes[order]), enough)) + 1]
            reach *= 1.25
            if not np.isfinite(reach) or distance[known].min() == 0 or reach > 1e6:
                visit(np.flatnonzero(~np.isfinite(distance)))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _block_scores(k: int):
    def run(tables: pa.Table) -> Iterator[pa.RecordBatch]:
        key = tables.column("block").combine_chunks().to_numpy()
        cut = np.flatnonzero(np.diff(key, prepend=~key[0], append=~key[-1]))
        ids = tables.column("id").combine_chunks().to_numpy()
        is_query = tables.column("query").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        floor = tables.column("floor").combine_chunks().to_numpy(zero_copy_only=False)
        rows = tables.column("row").combine_chunks().to_numpy()
        vectors = _matrix(tables.column("vector"))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            ask = is_query[a:b]
            qid, q, least, vid, v, own = ids[a:b][ask], vectors[a:b][ask], floor[a:b][ask], ids[a:b][~ask], vectors[a:b][~ask], rows[a:b][~ask]
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(0, len(qid), 256) if len(vid) else ():
                rough = q[i : i + 256] @ v.T
                rough[qid[i : i + 256, None] == vid[None, :]] = -np.inf
                last = np.maximum(np.partition(rough, -min(k, len(vid)), axis=1)[:, -min(k, len(vid))], least[i : i + 256])
                for j in range(len(rough)):
                    # rounding may move equal products apart, so all near the last place are scored again
                    near = np.flatnonzero((rough[j] >= last[j] - 1e-9 * max(1.0, abs(last[j]))) & np.isfinite(rough[j])) if np.isfinite(last[j]) else np.flatnonzero(np.isfinite(rough[j]))
                    score = (v[near] * q[i + j]).sum(axis=1)
                    order = np.lexsort((own[near], vid[near], -score))[:k]
                    out.append((np.full(len(order), qid[i + j]), vid[near][order], own[near][order], score[order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "row", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where queries holds."""
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.where(F.size("vector") == size["d"]), "vectors")
    norm = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    first, questions = _first_of_equal(rows, k)
    first = written(first, "candidates")
    total = first.count()
    share = min(1.0, SAMPLE / total)
    picked = first.where(F.pmod(F.xxhash64("id", "row", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "vector").toArrow()
    sample, sample_ids = _matrix(picked.column("vector")), picked.column("id").to_numpy()
    centre = centroids(_spread(sample if len(sample) else _matrix(first.limit(1).toArrow().column("vector")), norm), min(LISTS, total // AVERAGE))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            for i in range(0, len(v), 1024):
                d = np.sqrt(_squared(_spread(v[i : i + 1024], norm), centre))
                m = min(COPIES, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                reach = np.take_along_axis(d, near, axis=1)
                row, col = np.nonzero(reach <= NEAR * reach.min(axis=1, keepdims=True) + 1e-12)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)], ["list", "id", "vector", "row"])

    lists = written(first.mapInArrow(lean(filed), f"list long, id long, vector {kind}, row long"), "lists")
    held = np.zeros(len(centre), np.int64)
    for r in lists.groupBy("list").count().collect():  # at most LISTS rows
        held[r[0]] = r[1]
    graph = Graph(centre)

    nearest_list = np.concatenate([_squared(_spread(sample[i : i + 2048], norm), centre).argmin(axis=1) for i in range(0, len(sample), 2048)]) if len(sample) else np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((sample.astype(np.float32), sample_ids, nearest_list))

    def floors(ids: np.ndarray, q: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
        """What the k-th result of each query has at least: the k-th best of the sampled vectors in its lists."""
        known, known_ids, known_list = shared.value
        out = np.full(len(q), -np.inf)
        for i in range(0, len(q), 256) if len(known) > k else ():
            score = q[i : i + 256].astype(np.float32) @ known.T
            score[ids[i : i + 256, None] == known_ids[None, :]] = -np.inf
            for j, row in enumerate(score):
                inside = np.zeros(len(centre), bool)
                # what a split list holds may not all be searched
                inside[chosen[i + j][held[chosen[i + j]] <= SPLIT]] = True
                row[~inside[known_list]] = -np.inf
            out[i : i + 256] = np.partition(score, -k, axis=1)[:, -k]
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(out), out - 1e-4 * np.maximum(1.0, np.abs(out)), -np.inf)  # single precision is rounded

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1))
            plain = np.column_stack([q, np.zeros(len(q))])
            chosen = [graph.search(x, ratio, held, ENOUGH * k) for x in plain]
            floor = floors(batch.column(0).to_numpy(), q, chosen)
            at = pa.array(np.repeat(np.arange(len(q)), [len(c) for c in chosen]))
            picked = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(picked.astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(floor).take(at)], ["list", "id", "vector", "floor"])

    asks = written(questions.mapInArrow(lean(asked), f"list long, id long, vector {kind}, floor double"), "asked")
    lists, asks, sizes = _split(lists, asks, norm, ratio)
    grid = sizes.join(asks.groupBy("list").agg(F.count("*").alias("asks")), "list")
    grid = small_side(written(grid.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asks") / BATCH).cast("int").alias("batches")), "grid"))

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        df = df.join(grid, "list").withColumn(f"_{own}", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.select(F.xxhash64("list", "_blocks", "_batches").alias("block"), "id", F.lit(query).alias("query"), "vector", F.lit(0).cast("long").alias("row") if query else "row", "floor" if query else F.lit(0.0).alias("floor"))

    both = dealt(lists, "blocks", "batches", False).unionByName(dealt(asks, "batches", "blocks", True))
    scored = by_group(both, "block", _block_scores(k), "query_id long, vec_id long, row long, score double", rows=16384)
    # a row is in several lists; as a query it may be asked in several, too
    best = scored.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_of_equal(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(candidates (id, vector, row) without equal vectors that can't be found, queries (id, vector), each once).

    row tells rows of an id with equal vectors apart. Only vectors whose hash recurs are gathered by vector, and of those
    no more than the first ones leave a task.
    """
    every = rows.select("id", "vector", F.xxhash64("vector").alias("h"), "query")
    again = small_side(written(every.groupBy("h").count().where("count > 1").select("h"), "equal"))
    once, several = every.join(again, "h", "left_anti"), every.join(again, "h", "left_semi")
    copy = F.row_number().over(Window.partitionBy("vector", "id").orderBy("h"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id", "copy"))
    kept = several.select("id", "vector", "h").withColumn("copy", copy).where(F.col("copy") <= k).withColumn("place", place).where(F.col("place") <= 2 * k)
    candidates = once.select("id", "vector", F.col("h").alias("row")).unionByName(kept.select("id", "vector", F.xxhash64("h", "copy").alias("row")))
    asked = several.where("query").select("id", "vector", "h").withColumn("copy", copy).where("copy = 1")
    return candidates, once.where("query").select("id", "vector").unionByName(asked.select("id", "vector"))


def _fitted(norm: float):
    """Centroids of each list's sampled vectors."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("list").combine_chunks().to_numpy()
        parts = table.column("parts").combine_chunks().to_numpy()
        cut = np.flatnonzero(np.diff(key, prepend=~key[0], append=~key[-1]))
        vectors = _matrix(table.column("vector"))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            centre = centroids(_spread(vectors[a:b], norm), int(parts[a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(centre), key[a])), pa.array(list(centre), pa.list_(pa.float64()))], ["list", "vector"])

    return run


def _refiled(norm: float, ratio: float):
    """Vectors and queries of a block of a long list to its parts; the rows without an id are the parts' centroids."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table.column("block").combine_chunks().to_numpy()
        kind = table.column("kind").combine_chunks().to_numpy()
        cut = np.flatnonzero(np.diff(block, prepend=~block[0], append=~block[-1]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part, own = table.slice(a, b - a), kind[a:b]
            centre = _matrix(part.column("vector").take(pa.array(np.flatnonzero(own == 0))))
            # the same order of the centroids in every block
            centre = centre[np.lexsort(centre.T[::-1])]
            for k, copies, reach in ((1, HALVES, NEAR), (2, len(centre), ratio)):
                at = np.flatnonzero(own == k)
                for i in range(0, len(at), 1024):
                    some = part.take(pa.array(at[i : i + 1024]))
                    v = _matrix(some.column("vector"))
                    d = np.sqrt(_squared(_spread(v, norm) if k == 1 else np.column_stack([v, np.zeros(len(v))]), centre))
                    order = np.argsort(d, axis=1, kind="stable")[:, :copies]
                    far = np.take_along_axis(d, order, axis=1)
                    keep = far <= reach * far[:, :1] + 1e-12
                    if k == 2:
                        keep[:, :LEAST] = True
                    row, col = np.nonzero(keep)
                    out = some.select(["list", "kind", "id", "vector", "row", "floor"]).take(pa.array(row))
                    out = out.append_column("part", pa.array(order[row, col].astype(np.int32)))
                    yield from out.combine_chunks().to_batches()

    return run


def _split(lists: DataFrame, asks: DataFrame, norm: float, ratio: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, asks, sizes of the lists) with lists of more than SPLIT vectors split until none is or LEVELS are through."""
    kind = lists.schema["vector"].dataType.simpleString()
    moves = f"list long, kind int, id long, vector {kind}, row long, floor double, part int"
    for level in range(LEVELS + 1):
        sizes = written(lists.groupBy("list").count(), "sizes")
        long_ = sizes.where(F.col("count") > SPLIT)
        if level == LEVELS or long_.isEmpty():
            return lists, asks, sizes
        parts = F.least(F.lit(PARTS), F.greatest(F.lit(2), F.ceil(F.col("count") / PART))).cast("int")
        plan = small_side(written(long_.select("list", parts.alias("parts"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), (F.lit(FITTED) / F.col("count")).alias("share")), "plan"))
        here = lists.join(plan, "list")
        sample = here.where(F.pmod(F.xxhash64("id", "row", F.lit(level)), F.lit(1 << 20)) < F.col("share") * (1 << 20) + 1)
        heads = written(by_group(sample.select("list", "parts", "vector"), "list", _fitted(norm), "list long, vector array<double>", rows=FITTED), "heads")
        null = F.lit(None).cast("long")
        every = [
            heads.join(plan, "list").select("list", F.lit(0).alias("kind"), null.alias("id"), F.col("vector").cast(kind).alias("vector"), null.alias("row"), F.lit(0.0).alias("floor"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")),
            here.select("list", F.lit(1).alias("kind"), "id", "vector", "row", F.lit(0.0).alias("floor"), F.pmod(F.xxhash64("id", "row"), F.col("blocks")).cast("int").alias("b")),
            asks.join(plan, "list").select("list", F.lit(2).alias("kind"), "id", "vector", null.alias("row"), "floor", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b")),
        ]
        dealt = every[0].unionByName(every[1]).unionByName(every[2]).select(F.xxhash64("list", "b").alias("block"), "list", "kind", "id", "vector", "row", "floor")
        moved = written(by_group(dealt, "block", _refiled(norm, ratio), moves, rows=BLOCK, order=("kind",)), "parts")
        named = moved.withColumn("list", F.xxhash64("list", "part", F.lit(level)))
        lists = written(lists.join(plan, "list", "left_anti").unionByName(named.where("kind = 1").select("list", "id", "vector", "row")), "lists")
        asks = written(asks.join(plan, "list", "left_anti").unionByName(named.where("kind = 2").select("list", "id", "vector", "floor")), "asked")
    raise AssertionError
