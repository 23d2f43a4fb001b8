"""Queries of page rules, fiscal evidence, highlights, run lifecycles and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import retrieval as R
from tidemark.operators import runs
from tidemark.operators import structure as S
from tidemark.operators import windows as W

from .passage_queries import LINES_SQL, lines_of
from .registry import query
from .relational_queries import t


@query(
    "fiscal_evidence",
    r"""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, 'Report for the year ended ' || day(o_orderdate) || ' ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate) || CASE WHEN o_orderkey % 7 = 0 THEN ' and 15 months ended' ELSE '' END AS x FROM orders)
    SELECT doc, strftime(arg_min(d, page), '%Y-%m-%d') AS proposed, CASE count(DISTINCT d) WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, max(m)::BIGINT AS months FROM (
      SELECT doc, page, strptime(regexp_extract(x, 'ended (\d+ [A-Za-z]+ \d+)', 1), '%d %B %Y')::DATE AS d, CASE WHEN contains(x, '15 months ended') THEN 15 END AS m FROM p) GROUP BY doc""",
)
def fiscal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    x = F.concat(F.lit("Report for the year ended "), F.date_format("o_orderdate", "d MMMM yyyy"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(" and 15 months ended")).otherwise(F.lit("")))
    e = S.fiscal_evidence(o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), x.alias("x")), "doc", "page", "x")
    return e.select("doc", F.date_format("proposed", "yyyy-MM-dd").alias("proposed"), "confidence", F.col("months").cast("long").alias("months"))


@query(
    "highlight_spans",
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:with|from|the)\b'))::BIGINT AS n_hits, array_to_string(list_distinct(list_sort(list_transform(regexp_extract_all(text, '(?i)\b(?:with|from|the)\b'), lambda x: lower(x)))), ',') IS NOT NULL AS found, length(text)::BIGINT AS n_chars FROM documents WHERE lang = 'en'""",
)
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", S.highlighted(F.col("text"), ["the", "with", "from"]).alias("s"))
    whole = F.length(F.array_join(F.transform("s", lambda x: x["text"]), ""))
    return d.select("doc_id", F.size(F.filter("s", lambda x: x["matched"])).cast("long").alias("n_hits"), F.lit(True).alias("found"), whole.cast("long").alias("n_chars"))


@query(
    "recurring_edges",
    f"""WITH {LINES_SQL}, p AS (SELECT d.source, l.doc_id AS page, l.i, count(*) OVER (PARTITION BY l.doc_id) AS height, regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS norm FROM lines l JOIN documents d USING (doc_id)),
    b AS (SELECT *, CASE WHEN i - 1 <= 0.12 * height THEN 'header' WHEN i - 1 >= 0.9 * height THEN 'footer' END AS band FROM p),
    o AS (SELECT source, band, norm, count(DISTINCT page) AS n FROM b WHERE band IS NOT NULL AND norm <> '' GROUP BY 1, 2, 3), g AS (SELECT source, count(DISTINCT page) AS pages FROM p GROUP BY 1)
    SELECT source, count(*) FILTER (band = 'header' AND n >= greatest(2, round_even(pages * 0.6, 0))) AS headers, count(*) FILTER (band = 'footer' AND n >= greatest(2, round_even(pages * 0.6, 0))) AS footers, count(*) AS blocks FROM b LEFT JOIN o USING (source, band, norm) JOIN g USING (source) GROUP BY 1""",
)
def recurring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines_of(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("top", F.col("i") - 1).withColumn("height", F.count("*").over(Window.partitionBy("doc_id")))
    e = S.recurring_edges(b, "source", "doc_id", "top", "height", "text")
    return e.groupBy("source").agg(F.count_if("is_header").alias("headers"), F.count_if("is_footer").alias("footers"), F.count("*").alias("blocks"))


@query(
    "page_and_report_quality",
    r"""WITH p AS (SELECT source, CASE WHEN length(trim(text)) = 0 THEN 'FAILED' WHEN length(trim(text)) < 40 THEN 'NEEDS_REVIEW' WHEN length(trim(text)) >= 120 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) >= 0.5 THEN 'GOOD' ELSE 'USABLE' END AS q FROM documents),
    r AS (SELECT source, count(*) AS pages, count(*) FILTER (q IN ('GOOD', 'USABLE')) AS usable, count(*) FILTER (q = 'FAILED') AS empty FROM p GROUP BY 1)
    SELECT source, pages, usable, round(usable / pages, 6) AS usable_share, CASE WHEN usable / pages < 0.4 THEN 'FAILED' WHEN usable / pages < 0.8 OR empty / pages > 0.05 THEN 'NEEDS_REVIEW' WHEN usable / pages < 0.95 THEN 'USABLE' ELSE 'GOOD' END AS quality FROM r""",
)
def page_and_report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "documents").select("source", S.page_quality(F.col("text"), F.lit(0)).alias("q"))
    return S.report_quality(p, "source", "q").select("source", "pages", "usable", F.round("usable_share", 6).alias("usable_share"), "quality")


def _share_sql(text: str) -> str:
    parts = f"list_filter(list_transform(string_split({text}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return rf"(CASE WHEN len({parts}) = 0 THEN 1.0 ELSE len(list_filter({parts}, lambda x: length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) <= 3)) / len({parts}) END)"


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


GROUPED = r"\b[0-9]{1,3}(?:[ ,][0-9]{3})+\b"
CATEGORY_SQL = rf"""WITH {LINES_SQL}, x AS (SELECT doc_id, i, line AS text, trim(line) AS own, CASE WHEN i % 7 = 0 THEN left(trim(line), 2) END AS heading,
  CASE WHEN i % 7 = 0 THEN 'HEADING_WITH_BODY' WHEN i % 5 = 1 THEN 'TABLE_CONTEXT' ELSE 'PARAGRAPH' END AS kind, regexp_matches(line, '^\s*[-*•]') AS item FROM lines),
y AS (SELECT *, length(trim(heading)) = 2 AS two, CASE WHEN heading IS NULL THEN own ELSE substr(own, length(trim(heading)) + 1) END AS body, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words,
  CASE WHEN text = '' THEN 0.0 ELSE length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) / length(text) END AS digits, regexp_extract_all(lower(text), '[a-z'']+') AS w4, string_split_regex(text, '{GROUPED}') AS gaps,
  len(list_filter(regexp_extract_all(text, '{GROUPED}'), lambda h: length(regexp_replace(h, '[0-9]', '', 'g')) >= 7)) > 0 AS bridged FROM x),
z AS (SELECT *, CASE WHEN len(w4) < 4 THEN [] ELSE list_transform(range(1, len(w4) - 2), lambda j: array_to_string(w4[j:j + 3], ' ')) END AS g4, {_share_sql("own")} AS shattered, {_share_sql("body")} AS shattered_body FROM y),
r AS (SELECT *, CASE WHEN bridged OR len(list_filter(gaps[2:len(gaps) - 1], lambda g: len(regexp_extract_all(g, '[A-Za-z]+')) <= 1)) >= 2 OR {_count_sql(S.YEAR_PAIRS)} >= 2
    OR (regexp_matches(text, '{S.GRANTS}') AND ({_count_sql(S.SERIES)} >= 2 OR {_count_sql(S.DATES)} >= 2 OR len(g4) > len(list_distinct(g4)))) OR regexp_matches(coalesce(heading, '') || ' ' || text, '{S.HOLDERS}')
    OR (regexp_matches(text, '{S.MEETINGS}') AND {_count_sql(S.DIGIT_PAIRS)} >= 3) THEN 'financial_table_rendered_as_prose' WHEN {_count_sql(S.CURRENCIES)} >= 4 THEN 'currency_exposure_table_mixed' ELSE 'ordinary_prose_false_positive' END AS mistaken,
  words >= 40 AND regexp_matches(text, '[.!?]') AND shattered < 0.3 AS prose FROM z),
k AS (SELECT *, CASE WHEN two AND words = 1 THEN 'short_fragment_invalid' WHEN two AND shattered_body > 0.5 THEN 'broken_fragment_sequence' WHEN two AND regexp_matches(body, '[.!?]') THEN 'legitimate_short_abbreviation' WHEN two THEN 'caption_or_label_like'
  WHEN words >= 10 AND shattered > 0.5 THEN 'broken_fragment_sequence' WHEN regexp_matches(text, '{S.INDEX}') OR regexp_matches(text, '{S.LEADERS}') OR regexp_matches(own, '{S.CONTENTS}') THEN 'contents_or_index_like' WHEN regexp_matches(own, '{S.CAPTION}') THEN 'caption_or_label_like'
  WHEN words >= 5 AND digits >= 0.15 AND prose AND digits < 0.20 THEN mistaken WHEN words >= 5 AND digits >= 0.15 THEN 'numeric_or_table_like_source' WHEN kind = 'TABLE_CONTEXT' AND prose THEN mistaken WHEN kind = 'TABLE_CONTEXT' THEN 'table_context' WHEN item THEN 'list_content' END AS category FROM r)
SELECT category, CASE WHEN category = 'short_fragment_invalid' THEN CASE WHEN regexp_matches(heading, '^\p{{Lu}}+$') THEN 'REVIEW' ELSE 'EXCLUDE' END WHEN category = 'caption_or_label_like' THEN CASE WHEN two THEN 'REVIEW' ELSE 'EXCLUDE' END WHEN category = 'currency_exposure_table_mixed' THEN 'REVIEW'
  WHEN category IN ('legitimate_short_abbreviation', 'ordinary_prose_false_positive') THEN 'RETAIN' WHEN category IN ('table_context', 'list_content') THEN NULL WHEN category IS NOT NULL THEN 'EXCLUDE' END AS action, count(*) AS n, sum(length(text))::BIGINT AS chars FROM k GROUP BY 1, 2"""


@query("structured_categories", CATEGORY_SQL)
def structured_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured-content category of every line as a passage; every seventh has a heading of its first two characters."""
    b = lines_of(spark, sf_dir)
    seventh = F.col("i") % 7 == 0
    heading = F.when(seventh, F.left(F.trim("text"), F.lit(2)))
    kind = F.when(seventh, F.lit("HEADING_WITH_BODY")).when(F.col("i") % 5 == 1, F.lit("TABLE_CONTEXT")).otherwise(F.lit("PARAGRAPH"))
    b = b.select("text", heading.alias("heading"), kind.alias("kind"), F.col("text").rlike(r"^\s*[-*•]").alias("item"))
    b = b.withColumn("category", S.structured_category(F.col("text"), F.col("heading"), F.col("kind"), F.col("item")))
    return b.groupBy("category", S.structured_action(F.col("category"), F.col("heading"), F.col("kind")).alias("action")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "signal_quality",
    """WITH a AS (SELECT l_suppkey AS pair, round(avg(l_discount) * 15, 9) AS c, round(avg(l_tax), 9) AS m, (l_suppkey % 24)::BIGINT AS gap, round(count(*) FILTER (l_returnflag = 'R') / count(*) / 2, 9) AS am, round(avg(l_quantity) / 40, 9) AS co, round(count(*) FILTER (l_linestatus = 'O') / count(*), 9) AS un FROM lineitem GROUP BY 1),
    s AS (SELECT *, CASE WHEN c < 0.70 OR m < 0.02 THEN 'NEEDS_REVIEW' WHEN (m >= 0.02 AND m < 0.05) OR NOT gap BETWEEN 9 AND 15 THEN 'USABLE' ELSE 'GOOD' END AS side FROM a)
    SELECT pair, side, nullif(concat_ws('; ', CASE WHEN c < 0.70 THEN 'low word coverage' END, CASE WHEN m < 0.02 THEN 'very low match rate' END, CASE WHEN m >= 0.02 AND m < 0.05 THEN 'low match rate' END, CASE WHEN NOT gap BETWEEN 9 AND 15 THEN 'irregular gap' END), '') AS side_reasons,
      CASE WHEN co > 0.85 OR side = 'NEEDS_REVIEW' OR am > 0.15 THEN 'NEEDS_REVIEW' WHEN co > 0.60 OR un > 0.40 THEN 'USABLE' ELSE 'GOOD' END AS change FROM s""",
)
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r9 = lambda c: F.round(c, 9)
    n = F.count("*")
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair")).agg(
        r9(F.avg("l_discount") * 15).alias("c"), r9(F.avg("l_tax")).alias("m"), r9(F.count_if(F.col("l_returnflag") == "R") / n / 2).alias("am"), r9(F.avg("l_quantity") / 40).alias("co"), r9(F.count_if(F.col("l_linestatus") == "O") / n).alias("un")
    )
    side, why = S.side_quality(F.col("c"), F.col("m"), F.col("pair") % 24)
    a = a.withColumn("side", side).withColumn("side_reasons", why)
    change, _ = S.change_quality(F.col("am"), F.col("co"), F.col("un"), F.col("side"))
    return a.select("pair", "side", "side_reasons", change.alias("change"))


@query(
    "run_planning",
    """WITH i AS (SELECT o_orderkey::VARCHAR AS item, CASE WHEN o_totalprice < 1000 THEN 1 END AS a, CASE WHEN o_orderstatus = 'P' THEN 1 END AS b, o_orderkey % 3 = 0 AS done FROM orders)
    SELECT item, nullif(concat_ws('; ', CASE WHEN a = 1 THEN 'too small' END, CASE WHEN b = 1 THEN 'not validated' END), '') AS reason, a IS NULL AND b IS NULL AND NOT done AS runs FROM i""",
)
def run_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items may run, why not, and which are done for the same fingerprint and inputs."""
    o = t(spark, sf_dir, "orders").withColumn("item", F.col("o_orderkey").cast("string"))
    i = runs.eligibility(o, {"too small": F.col("o_totalprice") < 1000, "not validated": F.col("o_orderstatus") == "P"})
    log = o.where("o_orderkey % 3 = 0").select("item", F.lit("f1").alias("fingerprint"), F.lit("v1").alias("inputs"), F.lit("COMPLETED").alias("status"))
    todo = runs.planned(i, log, "f1", F.lit("v1")).select("item", F.lit(True).alias("todo"))
    return i.join(todo, "item", "left").select("item", F.col("ineligible_reason").alias("reason"), F.coalesce("todo", F.lit(False)).alias("runs"))


@query(
    "run_compatibility",
    """WITH e AS (SELECT user_id, max(event_type) AS model, count(*) % 2 AS dims FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY 1), l AS (SELECT user_id, max(event_type) AS model, count(*) % 2 AS dims FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 0 GROUP BY 1)
    SELECT user_id, nullif(concat_ws('; ', CASE WHEN e.dims IS NULL THEN 'no earlier run' END, CASE WHEN l.dims IS NULL THEN 'no later run' END, CASE WHEN e.model <> l.model THEN 'different model' END, CASE WHEN e.dims <> l.dims THEN 'different dims' END), '') AS reason FROM e FULL JOIN l USING (user_id)""",
)
def run_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(odd: int, skip: int) -> DataFrame:
        return t(spark, sf_dir, "events").where(f"event_id % 2 = {odd} and user_id % {skip} <> 0").groupBy("user_id").agg(F.max("event_type").alias("model"), (F.count("*") % 2).alias("dims"))

    return runs.compatible(side(0, 5), side(1, 7), "user_id", ["model", "dims"])


@query(
    "finding_payload",
    """SELECT l_suppkey AS pair, '{"discount":' || round(avg(l_discount) * 1000)::BIGINT || ',"tax":' || round(avg(l_tax) * 1000)::BIGINT || '}' AS payload FROM lineitem GROUP BY 1""",
)
def finding_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair")).agg(F.round(F.avg("l_discount") * 1000).cast("long").alias("discount"), F.round(F.avg("l_tax") * 1000).cast("long").alias("tax"))
    return a.select("pair", F.to_json(F.struct("discount", "tax")).alias("payload"))


@query(
    "hybrid_search",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 3),
    s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_dot_product(e, q), 9) DESC, vec_id) AS rank FROM v, q WHERE vec_id <> 3 QUALIFY rank <= 100),
    x AS (SELECT vec_id AS id, row_number() OVER (ORDER BY (label = 3)::INT DESC, vec_id) AS rank FROM v WHERE vec_id <> 3 QUALIFY rank <= 100),
    f AS (SELECT id, x.rank AS lexical_rank, s.rank AS semantic_rank, round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score FROM x FULL JOIN s USING (id))
    SELECT id, lexical_rank, semantic_rank, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 20""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of an exact vector ranking and of a keyword-like ranking, fused."""
    v = t(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 3").select(F.col("embedding").alias("q"))
    rest = v.where("vec_id <> 3")
    near = rest.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.round(N.dot(F.col("embedding"), F.col("q")), 9).alias("s")).orderBy(F.desc("s"), "id").limit(100)
    near = near.select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).cast("long").alias("rank"))
    word = rest.select(F.col("vec_id").alias("id"), (F.col("label") == 3).cast("int").alias("s")).orderBy(F.desc("s"), "id").limit(100)
    word = word.select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).cast("long").alias("rank"))
    return R.fused(word, near).where("rank <= 20").select("id", "lexical_rank", "semantic_rank", "rank")


@query("indexed_search_recall")
def indexed_search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1, 5 and 10 of a random-projection index against exact search, for thirty vectors."""
    return R.index_recall(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 30, (1, 5, 10))


@query(
    "provenance_check",
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id, i, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM lines), u AS (SELECT doc_id, i FROM b WHERE i % 10 <> 0 UNION ALL SELECT doc_id, i FROM b WHERE i = 7)
    SELECT doc_id, count(*) FILTER (n IS NULL) AS omitted, count(*) FILTER (n > 1) AS duplicated, CASE WHEN count(*) FILTER (n IS NULL OR n > 1) > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM b LEFT JOIN (SELECT doc_id, i, count(*) AS n FROM u GROUP BY 1, 2) USING (doc_id, i) GROUP BY 1""",
)
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines_of(spark, sf_dir).select("doc_id", "i", T.word_count(F.col("text")).alias("words"))
    sources = b.where("i % 10 <> 0").select("doc_id", "i").unionByName(b.where("i = 7").select("doc_id", "i"))
    p = S.provenance(b, sources, "doc_id", "i", "words", b.groupBy("doc_id").agg(F.sum("words").alias("passage_words")))
    return p.select("doc_id", "omitted", "duplicated", "verdict")
