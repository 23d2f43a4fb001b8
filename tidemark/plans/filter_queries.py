"""Queries of the serving filters, projections, publication rules and orders over the star schema and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import serving as S
from tidemark.operators import windows as W

from .passage_queries import BLOCKS_SQL, blocks_of
from .registry import query
from .relational_queries import t

COMPARED_SQL = """p AS (SELECT l_orderkey * 10 + l_linenumber AS comparison_id, l_suppkey AS pair, (l_orderkey + l_linenumber) % 6 AS k, * FROM lineitem),
compared AS (SELECT comparison_id, pair, CASE k WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'LIGHTLY_MODIFIED' WHEN 2 THEN 'SUBSTANTIALLY_MODIFIED' WHEN 3 THEN 'NEW' WHEN 4 THEN 'REMOVED' ELSE 'AMBIGUOUS' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN k <> 3 THEN l_partkey END AS earlier_id, CASE WHEN k <> 4 THEN l_orderkey % 20000 + 1 END AS later_id,
  CASE WHEN k <> 3 AND l_linestatus = 'O' THEN 'h' || l_linenumber END AS earlier_heading, CASE WHEN k <> 4 AND l_returnflag = 'R' THEN 'h' || l_linenumber END AS later_heading,
  CASE WHEN k <> 3 THEN l_partkey % 50 END AS earlier_first_page, CASE WHEN k <> 3 THEN l_partkey % 50 + 2 END AS earlier_last_page, CASE WHEN k <> 4 THEN l_orderkey % 50 END AS later_first_page, CASE WHEN k <> 4 THEN l_orderkey % 50 + 1 END AS later_last_page,
  l_quantity > 40 AS collision, l_discount > 0.08 AS split FROM p)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as compared passages with two sides, of which NEW lacks the earlier and REMOVED the later one."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    e, w = (lambda c: F.when(k != 3, c)), (lambda c: F.when(k != 4, c))
    flag, line = F.col("l_returnflag"), F.concat(F.lit("h"), F.col("l_linenumber").cast("string"))
    return t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comparison_id"), F.col("l_suppkey").alias("pair"), F.get(F.array(*[F.lit(s) for s in S.STATUSES]), k.cast("int")).alias("status"),
        F.when(flag == "A", F.lit("HIGH")).when(flag == "N", F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("confidence"), e(F.col("l_partkey")).alias("earlier_id"), w(F.col("l_orderkey") % 20000 + 1).alias("later_id"),
        F.when((k != 3) & (F.col("l_linestatus") == "O"), line).alias("earlier_heading"), F.when((k != 4) & (flag == "R"), line).alias("later_heading"),
        e(F.col("l_partkey") % 50).alias("earlier_first_page"), e(F.col("l_partkey") % 50 + 2).alias("earlier_last_page"), w(F.col("l_orderkey") % 50).alias("later_first_page"), w(F.col("l_orderkey") % 50 + 1).alias("later_last_page"),
        (F.col("l_quantity") > 40).alias("collision"), (F.col("l_discount") > 0.08).alias("split"),
    )


@query(
    "evidence_filter",
    f"""WITH {COMPARED_SQL} SELECT comparison_id, pair, status FROM compared WHERE confidence = 'MEDIUM' AND NOT collision AND (earlier_heading IS NOT NULL OR later_heading IS NOT NULL) AND coalesce(earlier_first_page, later_first_page) >= 5 AND coalesce(earlier_last_page, later_last_page) <= 40
    AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = comparison_id // 10 AND o_orderstatus = 'F' AND o_totalprice > 100000)""",
)
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared passages under some of the optional filters; a category counts where an order of the line has it."""
    rows = compared(spark, sf_dir).withColumn("order_id", F.floor(F.col("comparison_id") / 10))
    signals = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("comparison_id"), F.col("o_orderstatus").alias("category"), F.lit("all").alias("subcategory"), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("raw_count"))
    rows = rows.withColumnsRenamed({"comparison_id": "line_id", "order_id": "comparison_id"})
    out = S.evidence(rows, signals, status="ALL", confidence="MEDIUM", collision=False, heading=True, first_page=5, last_page=40, category="F")
    return out.select(F.col("line_id").alias("comparison_id"), "pair", "status")


@query(
    "review_worklist",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status, CASE o_orderstatus WHEN 'P' THEN 'NEEDS_REVIEW' WHEN 'F' THEN 'GOOD' END AS quality, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice > 20000 END AS eligible FROM orders)
    SELECT o_orderkey, status, quality FROM o WHERE status IS NULL OR status IN ('FAILED', 'COMPLETED_WITH_WARNINGS') OR quality IN ('NEEDS_REVIEW', 'FAILED') OR eligible = false""",
)
def review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit("COMPLETED_WITH_WARNINGS")).otherwise(F.lit("COMPLETED"))
    quality = F.when(s == "P", F.lit("NEEDS_REVIEW")).when(s == "F", F.lit("GOOD"))
    eligible = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None)).otherwise(F.col("o_totalprice") > 20000)
    return t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), quality.alias("quality"), eligible.alias("eligible")).where(S.needs_review(F.col("status"), F.col("quality"), F.col("eligible"))).drop("eligible")


@query(
    "displayed_scores",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END END AS shown FROM orders",
)
def displayed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.when(F.col("o_orderstatus") == "P", F.lit("FAILED")).when(F.col("o_orderstatus") == "F", F.lit("GOOD"))
    score = F.when(F.col("o_orderkey") % 5 != 0, F.round("o_totalprice", 2))
    return t(spark, sf_dir, "orders").select("o_orderkey", S.displayed(quality, score).alias("shown"))


@query(
    "published_alignment_rows",
    f"""WITH {COMPARED_SQL}, shown AS (SELECT p_partkey AS id FROM part WHERE p_size > 10), r AS (SELECT comparison_id, status, e.id AS earlier_id, w.id AS later_id FROM compared LEFT JOIN shown e ON e.id = earlier_id LEFT JOIN shown w ON w.id = later_id)
    SELECT * FROM r WHERE (earlier_id IS NOT NULL OR later_id IS NOT NULL) AND NOT (status IN ('UNCHANGED', 'LIGHTLY_MODIFIED', 'SUBSTANTIALLY_MODIFIED') AND (earlier_id IS NULL OR later_id IS NULL)) AND NOT (status = 'NEW' AND later_id IS NULL) AND NOT (status = 'REMOVED' AND earlier_id IS NULL)""",
)
def published_alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = t(spark, sf_dir, "part").where("p_size > 10")
    rows = compared(spark, sf_dir).select("comparison_id", "status", "earlier_id", "later_id")
    return S.published_rows(rows, shown, "p_partkey", "earlier_id", "later_id")


@query(
    "passage_comparison_detail",
    f"""WITH {COMPARED_SQL} SELECT comparison_id, status, confidence, earlier_id, e.p_name AS earlier_p_name, e.p_size AS earlier_p_size, later_id, w.p_name AS later_p_name, w.p_size AS later_p_size FROM compared LEFT JOIN part e ON e.p_partkey = earlier_id LEFT JOIN part w ON w.p_partkey = later_id""",
)
def passage_comparison_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each compared passage beside each other."""
    rows = compared(spark, sf_dir).select("comparison_id", "status", "confidence", "earlier_id", "later_id")
    return S.both_sides(rows, t(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_size"])


@query(
    "comparison_rows",
    """SELECT o_custkey, earlier_key, earlier_price, later_key, later_price, round(later_price - earlier_price, 2) AS price_change FROM (SELECT o_custkey, o_orderkey AS earlier_key, o_totalprice AS earlier_price, lead(o_orderkey) OVER w AS later_key, lead(o_totalprice) OVER w AS later_price
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE later_key IS NOT NULL""",
)
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.similarity import consecutive

    o = t(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    pairs = consecutive(o, "o_custkey", "at", ["key", "price"]).withColumn("price_change", F.round(F.col("later_price") - F.col("earlier_price"), 2))
    return pairs.select(*S.comparison_columns("o_custkey", {"earlier": ["key", "price"], "later": ["key", "price"]}, ["price_change"]))


@query(
    "passage_block_types",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, (i - 1) // 3 AS passage, array_to_string(list(block_type ORDER BY i), ',') AS types FROM blocks GROUP BY 1, 2""",
)
def passage_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the blocks of each passage, here three lines in a row, through a bridge table."""
    b = blocks_of(spark, sf_dir).withColumn("block", F.struct("doc_id", "i"))
    bridge = b.select(F.struct("doc_id", F.floor((F.col("i") - 1) / 3).alias("passage")).alias("p"), "block", F.col("i").alias("source_order"))
    out = S.block_types_of(bridge, b, "p", "block", "source_order", "block_type")
    return out.select("p.doc_id", "p.passage", F.array_join("types", ",").alias("types"))


@query(
    "lineage_guard",
    """WITH f AS (SELECT c_custkey AS pair, max(o_orderkey) AS run FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1), l AS (SELECT o_custkey AS pair, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, count(*) AS hits FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1)
    SELECT f.pair, f.run, CASE WHEN l.run = f.run THEN hits END AS hits, l.run IS NOT NULL AND l.run <> f.run AS mismatch FROM f LEFT JOIN l USING (pair)""",
)
def lineage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language result counts only for the run that it was made from."""
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "pair")
    features = o.groupBy("pair").agg(F.max("o_orderkey").alias("run"))
    language = o.where("pair % 4 <> 0").groupBy("pair").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"), F.count("*").alias("hits"))
    return S.of_same_lineage(features, language, "pair", "run", ["hits"])


@query(
    "page_adjacency",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey AS report, l_partkey % 200 AS page FROM lineitem) SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY report ORDER BY page RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 1 AS near FROM c""",
)
def page_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("report"), (F.col("l_partkey") % 200).alias("page"))
    return S.near_another(c, "report", "page").select("l_orderkey", "l_linenumber", "near")


@query(
    "evidence_page_order",
    f"""WITH {COMPARED_SQL} SELECT comparison_id, coalesce(earlier_first_page, CASE WHEN comparison_id % 9 = 0 THEN NULL ELSE later_first_page END) AS page, row_number() OVER (ORDER BY coalesce(earlier_first_page, CASE WHEN comparison_id % 9 = 0 THEN NULL ELSE later_first_page END) ASC NULLS LAST, comparison_id) AS place FROM compared WHERE status = 'NEW' AND pair = 7 ORDER BY place LIMIT 50""",
)
def evidence_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a comparison's evidence by page, unknown pages last."""
    from tidemark.operators.aggregates import page

    at = F.coalesce("earlier_first_page", F.when(F.col("comparison_id") % 9 != 0, F.col("later_first_page")))
    rows = compared(spark, sf_dir).where("status = 'NEW' and pair = 7").select("comparison_id", at.alias("page"))
    return page(rows, S.by_page(rows, F.col("page"), "comparison_id"), 1, 50).select("comparison_id", "page", F.col("position").alias("place"))


@query(
    "facet_option_order",
    """WITH f AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, row_number() OVER (ORDER BY CASE value WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, value) AS place FROM f""",
)
def facet_option_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a facet, known ones first; a facet has few values."""
    from pyspark.sql import Window

    f = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    return f.withColumn("place", F.row_number().over(Window.orderBy(*S.facet_order(F.col("value"), ["3-MEDIUM", "1-URGENT"]))).cast("long"))


@query(
    "merged_strategies",
    """WITH c AS (SELECT 'whole' AS strategy, text, doc_id FROM documents UNION ALL SELECT 'first_line', string_split(text, chr(10))[1], doc_id FROM documents UNION ALL SELECT 'last_line', string_split(text, chr(10))[-1], doc_id FROM documents)
    SELECT strategy, sha256(text) AS text_hash, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS members, count(*) AS n FROM c GROUP BY 1, 2""",
)
def merged_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lines = t(spark, sf_dir, "documents").select("doc_id", "text"), F.split("text", "\n")
    made = F.explode(F.create_map(F.lit("whole"), F.col("text"), F.lit("first_line"), F.get(lines, F.lit(0)), F.lit("last_line"), F.element_at(lines, -1))).alias("strategy", "chunk")
    out = S.merged_strategies(d.select("doc_id", made), "strategy", "chunk", "doc_id")
    return out.select("strategy", "text_hash", F.array_join("members", ",").alias("members"), "n")


@query(
    "report_titles",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderpriority = '5-LOW' THEN 'FY' || year(o_orderdate) END, year(o_orderdate)::VARCHAR) AS title FROM orders""",
)
def report_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return t(spark, sf_dir, "orders").select("o_orderkey", S.title_year(F.when(F.col("o_orderstatus") == "F", d), F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("FY"), F.year(d).cast("string"))), F.year(d)).alias("title"))


@query(
    "category_counters",
    """SELECT user_id, coalesce(sum(value::BIGINT) FILTER (event_type = 'view'), 0)::BIGINT AS view, coalesce(sum(value::BIGINT) FILTER (event_type = 'refund'), 0)::BIGINT AS refund, coalesce(sum(value::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase, (2 + count(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'refund')))::BIGINT AS names
    FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY 1""",
)
def category_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by category with 0 for known categories that don't occur, and unknown ones beside them."""
    e = t(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.floor("value").cast("long")).alias("counts"))
    out = S.counters(e, "user_id", "counts", ["view", "refund"])
    get = lambda k: F.coalesce(F.try_element_at("totals", F.lit(k)), F.lit(0)).cast("long").alias(k)
    return out.select("user_id", get("view"), get("refund"), get("purchase"), F.size("totals").cast("long").alias("names"))


@query(
    "passage_types",
    f"""WITH {BLOCKS_SQL}, x AS (SELECT *, contains(line, '|') AS tb FROM blocks), y AS (SELECT *, coalesce(lag(tb) OVER w, false) OR coalesce(lead(tb) OVER w, false) AS near FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT doc_id, (i - 1) // 2 AS passage, list(block_type ORDER BY i) AS types, bool_or(near AND NOT tb) AS near, min(CASE WHEN block_type = 'HEADING' THEN line END) AS heading FROM y GROUP BY 1, 2)
    SELECT CASE WHEN heading IS NOT NULL THEN 'HEADING_WITH_BODY' WHEN len(list_filter(types, lambda v: v <> 'LIST_ITEM')) = 0 THEN 'LIST' WHEN near THEN 'TABLE_CONTEXT' WHEN len(types) > 1 THEN 'MULTI_PARAGRAPH' ELSE 'PARAGRAPH' END AS passage_type, count(*) AS n FROM p GROUP BY 1""",
)
def passage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = W.beside_tables(blocks_of(spark, sf_dir), ["doc_id"], "i", F.contains("text", F.lit("|")), F.lit(True))
    p = b.groupBy("doc_id", F.floor((F.col("i") - 1) / 2)).agg(F.collect_list("block_type").alias("types"), F.bool_or("near_table").alias("near"), F.min(F.when(F.col("block_type") == "HEADING", F.col("text"))).alias("heading"))
    return p.groupBy(S.passage_type(F.col("heading"), F.col("types"), F.col("near")).alias("passage_type")).agg(F.count("*").alias("n"))


@query(
    "metadata_status",
    """SELECT CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'REJECTED' WHEN o_orderstatus <> 'P' THEN 'VALIDATED' ELSE 'NEEDS_REVIEW' END AS status, count(*) AS n FROM orders GROUP BY 1""",
)
def metadata_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, F.lit(0)).otherwise(F.lit(9))
    period = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return t(spark, sf_dir, "orders").groupBy(S.metadata_status(pages, period).alias("status")).agg(F.count("*").alias("n"))
