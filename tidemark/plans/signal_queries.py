"""Queries of language signals, audits, sensitivity, context expansion and chunk retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators import features as C
from tidemark.operators import passages as P
from tidemark.operators import retrieval as R
from tidemark.operators import signals as S

from .analysis_queries import ROWS_SQL, change_rows
from .registry import query
from .relational_queries import t

SIGNALS_SQL = """sig AS (SELECT l_suppkey AS pair, CASE WHEN l_linenumber % 2 = 0 THEN 'EARLIER' ELSE 'LATER' END AS report_side, CASE l_orderkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REMOVED' ELSE 'UNCHANGED' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, (l_quantity * 4)::BIGINT AS words, (l_orderkey % 3)::BIGINT AS positive, (l_partkey % 4)::BIGINT AS negative FROM lineitem)"""


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, k = F.col("l_returnflag"), F.col("l_orderkey") % 4
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("EARLIER")).otherwise(F.lit("LATER")).alias("report_side"), F.when(k == 0, F.lit("NEW")).when(k == 1, F.lit("REMOVED")).otherwise(F.lit("UNCHANGED")).alias("status"),
        F.when(flag == "A", F.lit("HIGH")).when(flag == "N", F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("confidence"), (F.col("l_quantity") * 4).cast("long").alias("words"), (F.col("l_orderkey") % 3).alias("positive"), (F.col("l_partkey") % 4).alias("negative"),
    )


@query(
    "language_pair_features",
    f"""WITH {SIGNALS_SQL}, a AS (SELECT pair, coalesce(sum(words) FILTER (report_side = 'EARLIER'), 0)::BIGINT AS we, coalesce(sum(words) FILTER (report_side = 'LATER'), 0)::BIGINT AS wl, coalesce(sum(words) FILTER (status = 'NEW'), 0)::BIGINT AS wn, coalesce(sum(positive) FILTER (report_side = 'EARLIER'), 0)::BIGINT AS pe,
      coalesce(sum(positive) FILTER (report_side = 'LATER'), 0)::BIGINT AS pl, coalesce(sum(negative) FILTER (status = 'NEW'), 0)::BIGINT AS nn, coalesce(sum(positive + negative) FILTER (confidence IN ('HIGH', 'MEDIUM')), 0)::BIGINT AS sure FROM sig GROUP BY pair)
    SELECT pair, we AS words_earlier, wl AS words_later, pe AS positive_earlier, pl AS positive_later, sure AS sure_hits, round(CASE WHEN wl > 0 THEN pl * 1000 / wl END - CASE WHEN we > 0 THEN pe * 1000 / we END, 6) AS positive_rate_change, round(CASE WHEN wn > 0 THEN nn * 1000 / wn END, 6) AS negative_introduction FROM a""",
)
def language_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.pair_features(signal_rows(spark, sf_dir), "pair", ["positive", "negative"])
    return f.select("pair", "words_earlier", "words_later", "positive_earlier", "positive_later", "sure_hits", F.round("positive_rate_change", 6).alias("positive_rate_change"), F.round("negative_introduction", 6).alias("negative_introduction"))


@query(
    "alignment_audit",
    f"""WITH {SIGNALS_SQL} SELECT pair, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (contains(lower(status), 'mov')) AS moved, round(avg(positive), 4) AS mean_positive, round(100.0 * count(*) FILTER (status = 'UNCHANGED') / count(*), 4) AS percent_matched,
      any_value(CASE pair % 4 WHEN 0 THEN 'Analysis ready' WHEN 1 THEN 'Ready with caution' WHEN 2 THEN 'Review recommended' ELSE NULL END) AS quality_label, any_value(CASE pair % 4 WHEN 0 THEN 'Strong attribution' WHEN 1 THEN 'Usable attribution' WHEN 2 THEN 'Attribution uncertain' ELSE NULL END) AS attribution_label FROM sig GROUP BY pair""",
)
def alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.get(F.array(F.lit("GOOD"), F.lit("USABLE"), F.lit("NEEDS_REVIEW"), F.lit("OTHER")), (F.col("pair") % 4).cast("int"))
    a = signal_rows(spark, sf_dir).groupBy("pair").agg(
        F.count_if(F.col("confidence") == "HIGH").alias("high"), F.count_if(F.col("confidence") == "LOW").alias("low"), F.count_if(F.contains(F.lower("status"), F.lit("mov"))).alias("moved"), F.round(F.avg("positive"), 4).alias("mean_positive"),
        F.round(100.0 * F.count_if(F.col("status") == "UNCHANGED") / F.count("*"), 4).alias("percent_matched"),
    )
    return a.withColumn("quality_label", S.label(quality)).withColumn("attribution_label", S.label(quality, S.ATTRIBUTION_LABELS))


@query(
    "category_pivot",
    """SELECT s_nationkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS r_share, round(sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity), 6) AS r_word_share FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
)
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    flag = F.col("l_returnflag")
    return j.groupBy("s_nationkey").agg(*[F.count_if(flag == x).alias(x.lower()) for x in "ANR"], F.round(F.count_if(flag == "R") / F.count("*"), 6).alias("r_share"), F.round(F.sum(F.when(flag == "R", F.col("l_quantity"))) / F.sum("l_quantity"), 6).alias("r_word_share"))


@query(
    "best_parent",
    "SELECT l_partkey AS parent, max(l_extendedprice) AS best, min(l_orderkey) AS first_rank, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
)
def best_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("parent"), F.col("l_extendedprice").alias("s"), F.col("l_orderkey").alias("r"))
    return S.best_parent(hits, "parent", "s", "r")


@query(
    "cumulative_share",
    "SELECT source, doc_id, sum(n_chars) OVER w AS running, round(sum(n_chars) OVER w / sum(n_chars) OVER (PARTITION BY source), 6) AS share FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.cumulative_share(t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars")
    return out.select("source", "doc_id", "running", F.round("share", 6).alias("share"))


@query(
    "first_seen_order",
    """SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS seen FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_seen(t(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("seen"))


def _variant_sql() -> str:
    weight = "CASE WHEN status = 'NEW' THEN later_words WHEN status = 'REMOVED' THEN earlier_words WHEN status = 'AMBIGUOUS' THEN coalesce(earlier_words, later_words) ELSE (earlier_words + later_words) / 2.0 END::DOUBLE"
    score = " + ".join(f"{w} * coalesce(sum({weight}) FILTER (status = '{s}'), 0)" for s, w in C.WEIGHTS.items())
    parts = {"A": "true", "B": "(earlier_words IS NULL OR earlier_words >= 80)", "C": "(later_words IS NULL OR later_words >= 90)"}
    selects = " UNION ALL ".join(f"SELECT pair, '{v}' AS variant, count(*) AS n, round(({score}) / sum({weight}), 6) AS score FROM rows WHERE {k} GROUP BY 1" for v, k in parts.items())
    return f"WITH {ROWS_SQL} {selects}"


@query("feature_sensitivity", _variant_sql())
def feature_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change score after dropping rows in three ways, each row read once."""
    e, w = F.col("earlier_words"), F.col("later_words")
    v = S.variants(change_rows(spark, sf_dir), {"A": F.lit(True), "B": e.isNull() | (e >= 80), "C": w.isNull() | (w >= 90)})
    weight = C.row_weight(F.col("status"), e, w)
    factor = F.create_map(*[F.lit(x) for kv in C.WEIGHTS.items() for x in kv])[F.col("status")]
    return v.groupBy("pair", "variant").agg(F.count("*").alias("n"), F.round(F.sum(weight * factor) / F.sum(weight), 6).alias("score"))


@query(
    "side_rows",
    f"""WITH {ROWS_SQL} SELECT pair, status, s.side AS report_side, count(*) AS n, sum(s.w)::BIGINT AS words FROM (SELECT pair, status, unnest([struct_pack(side := 'EARLIER', w := earlier_words), struct_pack(side := 'LATER', w := later_words)]) AS s FROM rows) WHERE s.w IS NOT NULL GROUP BY 1, 2, 3""",
)
def side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.side_rows(change_rows(spark, sf_dir), "earlier_words", "later_words", "w")
    return rows.groupBy("pair", "status", "report_side").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


@query(
    "comparison_chunks",
    """WITH c AS (SELECT o_orderkey, o_custkey AS e, o_orderkey % 500 AS l, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT o_orderkey, 'Earlier: ' || a.text || chr(10) || chr(10) || 'Later: ' || b.text AS chunk FROM c JOIN documents a ON a.doc_id = c.e JOIN documents b ON b.doc_id = c.l""",
)
def comparison_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' texts of a comparison in one chunk; a comparison without both gives none.

    Later documents are few by the query itself (ids under 500) and are sent to every task, so a chunk's text is never shuffled.
    """
    c = t(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").select("o_orderkey", F.col("o_custkey").alias("e"), (F.col("o_orderkey") % 500).alias("l"))
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    j = c.join(d.select(F.col("doc_id").alias("e"), F.col("text").alias("et")), "e").join(F.broadcast(d.where("doc_id > -500 and doc_id < 500").select(F.col("doc_id").alias("l"), F.col("text").alias("lt"))), "l")
    return j.select("o_orderkey", F.concat(F.lit("Earlier: "), "et", F.lit("\n\nLater: "), "lt").alias("chunk"))


@query(
    "context_expansion",
    """WITH p AS (SELECT p_partkey FROM part WHERE p_size <= 10), c AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem WHERE l_quantity >= 20),
    x AS (SELECT p_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_orderkey, l_linenumber) AS n FROM p LEFT JOIN c ON l_partkey = p_partkey)
    SELECT p_partkey, max(l_orderkey * 10 + l_linenumber) FILTER (n = 1) AS lead_context, coalesce(string_agg((l_orderkey * 10 + l_linenumber)::VARCHAR, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 3), '') AS extra_contexts FROM x GROUP BY 1""",
)
def context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best context of each passage, and up to two more."""
    c = t(spark, sf_dir, "lineitem").where("l_quantity >= 20").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ctx"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("o"))
    n = F.row_number().over(Window.partitionBy("p_partkey").orderBy("o", "ctx"))
    best = c.withColumn("n", n).where("n <= 3").groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ctx"))), lambda x: x["ctx"]).alias("c"))
    out = t(spark, sf_dir, "part").where("p_size <= 10").select("p_partkey").join(best, "p_partkey", "left")
    extra = F.array_join(F.slice("c", 2, 2), ",")
    return out.select("p_partkey", F.get("c", F.lit(0)).alias("lead_context"), F.coalesce(extra, F.lit("")).alias("extra_contexts"))


@query(
    "candidate_sources",
    """WITH k AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY 1 QUALIFY r <= 40), s AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY 1 QUALIFY r <= 40),
    c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 40)
    SELECT id, max(r) FILTER (src = 'keyword') AS keyword_rank, max(r) FILTER (src = 'semantic') AS semantic_rank, max(r) FILTER (src = 'chunk') AS chunk_rank, count(*) AS n_sources FROM (SELECT id, r, 'keyword' AS src FROM k UNION ALL SELECT id, r, 'semantic' FROM s UNION ALL SELECT id, r, 'chunk' FROM c) GROUP BY 1""",
)
def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate an id from three ranked sources, with its rank in each."""
    g = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("m"), F.count("*").alias("n"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))

    def top(df: DataFrame, by: str, name: str) -> DataFrame:
        best = df.orderBy(F.desc(by), "id").limit(40)
        return best.select("id", F.row_number().over(Window.orderBy(F.desc(by), "id")).cast("long").alias("r"), F.lit(name).alias("src"))

    every = top(g, "m", "keyword").unionByName(top(g, "n", "semantic")).unionByName(top(c, "b", "chunk"))
    ranks = [F.max(F.when(F.col("src") == s, F.col("r"))).alias(f"{s}_rank") for s in ("keyword", "semantic", "chunk")]
    return every.groupBy("id").agg(*ranks, F.count("*").alias("n_sources"))


@query("chunk_retrieval")
def chunk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each question without overlapping ones; sequential choice over at most 25, tested on literals."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"), F.col("label").alias("company"))
    top = R.nearest_within(asked, v.select(F.col("vec_id").alias("id"), F.col("label").alias("company"), F.col("embedding").alias("e")), "company", 25)

    def run(rows: list[dict]) -> list[tuple]:
        items = [{"chunk_id": c, "similarity": float("-inf") if s is None else s, "report_id": c // 10, "members": [c // 2], "chunk_index": c % 10, "page_start": 3 * (c % 10), "page_end": 3 * (c % 10)} for c, s in ((r["id"], r["similarity"]) for r in rows)]
        return [(x["chunk_id"], i + 1) for i, x in enumerate(P.first_kept(items, 5))]

    return P.grouped(top, "q", ["id"], run, "q long, chunk_id long, place int")


@query(
    "evaluation_rates",
    """SELECT event_type, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS short_rate, coalesce(round(avg(CASE WHEN value < 40 THEN 1.0 ELSE 0.0 END) FILTER (user_id % 10 = 0), 6), 1.0) AS abstention_rate, coalesce(round(avg(CASE WHEN value > 80 THEN 1.0 ELSE 0.0 END) FILTER (user_id % 1000 = 999), 6), 0.0) AS false_support_rate FROM events GROUP BY 1""",
)
def evaluation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over filtered cases, with their value where there is no case."""
    share = lambda c: F.avg(c.cast("double"))
    v, u = F.col("value"), F.col("user_id")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(share(v < 10), 6).alias("short_rate"), F.coalesce(F.round(share(F.when(u % 10 == 0, v < 40)), 6), F.lit(1.0)).alias("abstention_rate"), F.coalesce(F.round(share(F.when(u % 1000 == 999, v > 80)), 6), F.lit(0.0)).alias("false_support_rate")
    )


@query(
    "wide_export",
    """SELECT o_orderkey, c_name, n_name, r_name, o_totalprice, count(l_linenumber) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND r_name = 'EUROPE' GROUP BY ALL""",
)
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row an item with its dimensions, filtered before the joins; dimensions are small and broadcast by size."""
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return o.join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.round("revenue", 4).alias("revenue"))
