"""Queries of what a reader is shown: series, semantic hits with their strength, evidence packages, normal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import questions as Q

from .registry import query
from .relational_queries import t

#: Similarity from which a hit is strong (fixed value of the service).
STRONG = 0.71


@query("compatible_form", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def compatible_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the NFKC form; the given texts are normalised already."""
    return t(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.compatible_form(F.col("text"))).alias("content_hash"))


@query(
    "metric_series",
    "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS position, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM orders",
)
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological values of each company; what isn't known stays as a gap."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", n.cast("long").alias("position"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))


@query(
    "semantic_search",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 5),
    s AS (SELECT vec_id, label, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 9) AS s, row_number() OVER (ORDER BY round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 9) DESC, vec_id) AS n FROM v, q WHERE vec_id <> 5 QUALIFY n <= 100),
    f AS (SELECT *, CASE WHEN label = 0 THEN 0.5 WHEN label = 1 THEN 0.6 ELSE 1.0 END AS factor FROM s)
    SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY round(s * factor, 9) DESC, vec_id) AS final_rank, CASE WHEN s >= 0.71 THEN 'STRONG' ELSE 'WEAK' END AS strength FROM f""",
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest, reranked by passage quality, with their strength."""
    v = t(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 5").select(F.col("embedding").alias("q"))
    hits = v.where("vec_id <> 5").join(F.broadcast(q)).select("vec_id", "label", F.round(N.cosine(F.col("embedding"), F.col("q")), 9).alias("s")).orderBy(F.desc("s"), "vec_id").limit(100).withColumn("one", F.lit(1))
    factor = Q.quality_factor(F.lit(10), F.col("label") == 0, F.col("label") == 1, F.lit(False))
    r = Q.reranked(hits, "one", "vec_id", F.col("s"), factor)
    return r.select("vec_id", F.round("s", 6).alias("similarity"), "final_rank", F.when(F.col("s") >= STRONG, F.lit("STRONG")).otherwise(F.lit("WEAK")).alias("strength"))


@query(
    "evidence_package",
    """SELECT user_id, '{"question":' || user_id || ',"evidence":[' || string_agg('{"id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY n) || ']}' AS package FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3 GROUP BY user_id""",
)
def evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    e = t(spark, sf_dir, "events").withColumn("n", n).where("n <= 3")
    items = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("event_id").alias("id"), F.col("event_type").alias("type")))), lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type")))
    return e.groupBy("user_id").agg(items.alias("evidence")).select("user_id", F.to_json(F.struct(F.col("user_id").alias("question"), "evidence")).alias("package"))


@query(
    "page_blocks",
    r"""SELECT page_id, (i - 1)::BIGINT AS block_index, b[i] AS text, length(b[i])::BIGINT AS n_chars FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:h[1-6]|p|div|ul|ol|li|section|blockquote|article|nav|footer|header|aside|table|tr|td|title|body|head|html)(?:\s[^>]*)?>'),
      lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?i)<br\s*/?>', ' ', 'g'), '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM pages))""",
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import pages

    b = pages.blocks(t(spark, sf_dir, "pages"), "page_id", "html")
    return b.select("page_id", F.col("block_index").cast("long").alias("block_index"), "text", F.length("text").cast("long").alias("n_chars"))
