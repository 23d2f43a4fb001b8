"""Rank fusion and ranked retrieval measures."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items and questions of a block that are compared with each other, about; digits by which similarities are ranked.
ITEMS, ASKED, DIGITS = 4_096, 512, 9


def fused(lexical: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two (id, rank) lists; of a repeated id the last rank counts. Ties go to the smaller id."""

    def ranks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.max("rank").alias(name))

    both = ranks(lexical, "lexical_rank").join(ranks(semantic, "semantic_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("lexical_rank") + part("semantic_rank"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).cast("long"))


def measures(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(case_id, recall, precision, reciprocal_rank, ndcg) at k of ranked (case_id, id, rank) against judged (case_id, id, gain).

    Recall is 1 where nothing is relevant; precision is over what was returned; nDCG is null without relevant items.
    """
    top = ranked.where(F.col("rank") <= k)
    joined = top.join(judged, ["case_id", "id"], "left")
    gain = F.coalesce("gain", F.lit(0))
    got = joined.groupBy("case_id").agg(
        F.count("*").alias("returned"), F.count_if(gain > 0).alias("hits"), F.min(F.when(gain > 0, F.col("rank"))).alias("first"), F.sum((F.pow(F.lit(2.0), gain) - 1) / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "id"))
    ideal = judged.where("gain > 0").withColumn("place", place).groupBy("case_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("place") + 1))).alias("ideal"))
    every = got.join(ideal, "case_id", "left")
    return every.select(
        "case_id", F.when(F.coalesce("relevant", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") / F.col("returned")).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def recovered(selected: Column, sets: Column) -> Column:
    """Whether any of the alternative sets is wholly selected."""
    return F.exists(sets, lambda s: F.size(F.array_except(s, selected)) == 0)


def index_recall(vectors: DataFrame, queries: int, at: tuple[int, ...], length: float = 0.5, tables: int = 12) -> DataFrame:
    """(k, recall) of a bucketed random-projection index against exact search, for the first ids as queries.

    Both sides are equi-joins on buckets or a broadcast of the few queries; vectors: id, embedding.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    asked = v.orderBy("id").limit(queries)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=length, numHashTables=tables, seed=7).fit(v)
    near = model.approxSimilarityJoin(asked, v, float("inf"), "distance").select(F.col("datasetA.id").alias("q"), F.col("datasetB.id").alias("id"), "distance").where("q <> id")

    def top(df: DataFrame) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("q").orderBy(F.round("distance", 9), "id"))
        return df.withColumn("rank", n).where(F.col("rank") <= max(at)).select("q", "id", "rank")

    ids = [r[0] for r in asked.select("id").collect()]
    few = vectors.where(F.col("id").isin(ids)).select(F.col("id").alias("q"), F.col("embedding").alias("e"))
    gap = F.sqrt(F.aggregate(F.zip_with("e", "embedding", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    exact = top(vectors.join(F.broadcast(few)).where("q <> id").select("q", "id", gap.alias("distance")))
    hits = exact.join(top(near).select("q", "id", F.col("rank").alias("found")), ["q", "id"], "left")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.avg(F.when(F.col("rank") <= k, (F.coalesce("found", F.lit(2**31)) <= k).cast("double"))).alias("recall")) for k in at])
    return hits.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.k", F.round("r.recall", 6).alias("recall"))


def _best(own: int, x: np.ndarray | None, ids: np.ndarray, v: np.ndarray, odd: list[tuple], near: np.ndarray, norms: np.ndarray, most: int) -> list[tuple]:
    """The most rows (id, similarity) for one question; near has similarities up to rounding, by which few rows are chosen."""
    if x is None:
        return [(i, None) for i in sorted({*ids.tolist(), *(i for i, _ in odd)} - {own})[:most]]
    there = np.flatnonzero(ids != own)
    if len(there) > most:
        least = np.partition(near[there], len(there) - most)[len(there) - most]
        there = there[near[there] >= least - 1e-8]
    found = [(i, None) for i, _ in odd if i != own]
    if len(there):
        # one product after the other, as a fold over the components adds them
        exact = np.cumsum(x * v[there], axis=1)[:, -1] / (np.sqrt(np.cumsum(x * x)[-1]) * norms[there])
        found += zip(ids[there].tolist(), exact.tolist(), strict=True)
    step = Decimal(1).scaleb(-DIGITS)
    rounded = {s: Decimal(repr(s)).quantize(step, ROUND_HALF_UP) for _, s in found if s is not None}
    return sorted(found, key=lambda r: (r[1] is None, 0 if r[1] is None else -rounded[r[1]], r[0]))[:most]


def nearest_within(asked: DataFrame, items: DataFrame, group: str, most: int) -> DataFrame:
    """(q, id, similarity) of the most similar items by cosine for each question in its group, ties by id; exact.

    asked: q, group, e; items: id, group, e, with a finite cosine or none. Every item of a group is compared with every
    question of it, so the work is quadratic in a group; it is dealt out in blocks of about ITEMS by ASKED, of which each
    passes on its best rows alone. Vectors that are null, empty, zero or of another length have no similarity and come last.
    """
    sizes = items.groupBy(group).agg(F.ceil(F.count("*") / ITEMS).alias("_n")).join(asked.groupBy(group).agg(F.ceil(F.count("*") / ASKED).alias("_m")), group)
    block = [group, "_v", "_q"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = items.join(sizes, group).select(group, F.pmod(F.xxhash64("id"), "_n").alias("_v"), upto("_m").alias("_q"), "id", "e")
    a = asked.join(sizes, group).select(F.col(group).alias(group), upto("_n").alias("_v"), F.pmod(F.xxhash64("q"), "_m").alias("_q"), F.col("q").alias("q"), F.col("e").alias("e"))  # columns of its own, where both come from one table

    def plain(e: object) -> np.ndarray | None:
        x = None if e is None else np.asarray(e, dtype=np.float64)  # null components become nan
        return None if x is None or not len(x) or np.isnan(x).any() or not x.any() else x

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        given = list(zip(right["id"].tolist(), (plain(e) for e in right["e"]), strict=True))
        questions = list(zip(left["q"].tolist(), (plain(e) for e in left["e"]), strict=True))
        for size in {0 if x is None else len(x) for _, x in questions}:
            own = [(q, x) for q, x in questions if (0 if x is None else len(x)) == size]
            same, odd = [r for r in given if r[1] is not None and len(r[1]) == size], [r for r in given if r[1] is None or len(r[1]) != size]
            ids, m = np.array([i for i, _ in same], dtype=np.int64), np.array([x for _, x in same]).reshape(len(same), size)
            norms = np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if len(same) else np.zeros(0)
            scaled = m / norms[:, None] if len(same) else m
            for q, x in own:
                near = scaled @ (x / np.sqrt(x @ x)) if x is not None else norms
                rows += [(q, i, s) for i, s in _best(q, x, ids, m, odd, near, norms, most)]
        return pd.DataFrame({"q": pd.Series([r[0] for r in rows], dtype="int64"), "id": pd.Series([r[1] for r in rows], dtype="int64"), "similarity": pd.Series([r[2] for r in rows], dtype="object")})

    found = a.groupBy(*block).cogroup(v.groupBy(*block)).applyInPandas(run, "q long, id long, similarity double")
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("similarity", F.round("similarity", DIGITS)).withColumn("_r", n).where(F.col("_r") <= most).drop("_r")
