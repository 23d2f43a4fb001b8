"""Queries of question analysis, evidence ranking, gates and their evaluation over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import questions as Q

from .registry import query
from .relational_queries import t

STOPS_SQL = "string_split('the a an and or but of to in on for is are was were did does what how why who which with about that this these those it its as at by from be has have had will would could should than then there their', ' ')"


@query(
    "question_analysis",
    rf"""WITH q AS (SELECT conv_id, turn, 'How did THE risk ' || CASE conv_id % 6 WHEN 0 THEN 'rising from 2019 to 2021' WHEN 1 THEN 'that was removed matter' WHEN 2 THEN 'stand in 2020 in the prior year''s report' WHEN 3 THEN 'no longer disclosed and slightly updated compare' WHEN 4 THEN 'history' ELSE 'look' END || '? ' || coalesce(text, '') AS q FROM conversations WHERE role = 'user'),
    l AS (SELECT *, lower(q) AS lo, list_distinct(regexp_extract_all(q, '\b((?:19|20)\d{{2}})\b', 1)) AS years, regexp_matches(q, '\bTHE\b') AS named FROM q),
    d AS (SELECT *, CASE WHEN regexp_matches(lo, '\b(increased?|rose|grew|higher|rising|up from|growth in)\b') THEN 'increased' WHEN regexp_matches(lo, '\b(decreased?|fell|declined?|lower|falling|down from|reduction in)\b') THEN 'decreased' WHEN regexp_matches(lo, '\b(added|newly introduced|introduced for the first time)\b') THEN 'added'
        WHEN regexp_matches(lo, '\b(removed|dropped|discontinued|eliminated|no longer)\b') THEN 'removed' WHEN regexp_matches(lo, '\b(changed|modified|updated|revised)\b') THEN 'changed' END AS direction,
      concat_ws(',', CASE WHEN regexp_matches(lo, '\bnewly (introduced|disclosed|added)\b|\bnew disclosure\b') THEN 'NEW' END, CASE WHEN regexp_matches(lo, '\bno longer (disclosed|reported|mentioned)\b|\bremoved disclosure\b') THEN 'REMOVED' END, CASE WHEN regexp_matches(lo, '\bunchanged\b|\bstayed the same\b') THEN 'UNCHANGED' END,
        CASE WHEN regexp_matches(lo, '\bslightly (modified|changed|updated)\b') THEN 'LIGHTLY_MODIFIED' END, CASE WHEN regexp_matches(lo, '\b(substantially|materially|significantly) (modified|changed|revised)\b') THEN 'SUBSTANTIALLY_MODIFIED' END, CASE WHEN regexp_matches(lo, '\bambiguous\b|\bunclear (change|status)\b') THEN 'AMBIGUOUS' END) AS statuses,
      concat_ws(',', CASE WHEN regexp_matches(lo, '\b(earlier|prior|previous|last year''?s?|preceding)\b') THEN 'EARLIER' END, CASE WHEN regexp_matches(lo, '\b(later|latest|current|most recent|this year''?s?|new(est)? report)\b') THEN 'LATER' END) AS sides FROM l),
    k AS (SELECT *, CASE WHEN regexp_matches(lo, '\bwhy\b|\bwhat (caused|led to|is the reason)\b|\breason for\b') THEN 'causal' WHEN regexp_matches(lo, '\bhow much\b|\bhow many\b|\bwhat (percentage|amount|proportion)\b') THEN 'quantitative' WHEN direction IS NOT NULL OR regexp_matches(lo, '\bcompar(e|ison|ed)\b|\bversus\b|\bvs\.?\b|\bdifference between\b') THEN 'comparative'
        WHEN regexp_matches(lo, '\bdoes\b|\bdid\b|\bis there\b|\bwas there\b|\bhas the company\b|\bhave they\b') THEN 'existence_based' WHEN len(years) > 1 OR regexp_matches(lo, '\bover time\b|\btrend\b|\bhistory\b|\btimeline\b') THEN 'chronological' ELSE 'descriptive' END AS kind,
      CASE WHEN NOT named THEN 'corpus_wide' WHEN direction IS NOT NULL OR len(years) > 1 THEN 'single_comparison' ELSE 'single_company' END AS scope FROM d)
    SELECT conv_id, turn, direction, statuses, sides, kind, scope, len(years)::BIGINT AS n_years, CASE WHEN len(years) > 0 THEN strftime(make_date(list_min(list_transform(years, lambda y: y::INT)), 1, 1), '%Y-%m-%d') END AS from_date,
      CASE WHEN kind IN ('comparative', 'chronological') OR scope = 'single_comparison' OR direction IS NOT NULL OR statuses <> '' THEN 'COMPARISON' WHEN scope = 'corpus_wide' THEN 'CORPUS' ELSE 'DOCUMENT' END AS route,
      len(list_filter(list_distinct(list_filter(string_split_regex(lo, '[^a-z0-9]+'), lambda w: length(w) >= 3)), lambda w: NOT list_contains({STOPS_SQL}, w)))::BIGINT AS n_concepts FROM k""",
)
def question_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, read whole."""
    endings = ["rising from 2019 to 2021", "that was removed matter", "stand in 2020 in the prior year's report", "no longer disclosed and slightly updated compare", "history", "look"]
    part = F.get(F.array(*[F.lit(x) for x in endings]), (F.col("conv_id") % 6).cast("int"))
    q = t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("How did THE risk "), part, F.lit("? "), F.coalesce("text", F.lit(""))).alias("q"))
    a = Q.analysed(q, "q", ["THE"])
    return a.select("conv_id", "turn", "direction", F.array_join("statuses", ",").alias("statuses"), F.array_join("sides", ",").alias("sides"), "kind", "scope", F.size("years").cast("long").alias("n_years"), F.date_format("from_date", "yyyy-MM-dd").alias("from_date"), Q.routed(a).alias("route"), F.size("concepts").cast("long").alias("n_concepts"))


@query(
    "quality_rerank",
    """WITH c AS (SELECT user_id, event_id, value / 100 AS s, (event_id % 30)::BIGINT AS words, event_type = 'view' AS ho, event_type = 'search' AS gh, event_id % 7 = 0 AS sig FROM events),
    f AS (SELECT *, CASE WHEN words >= 16 OR sig THEN 1.0 WHEN ho THEN 0.5 WHEN gh THEN 0.6 WHEN words < 8 THEN 0.85 ELSE 1.0 END AS factor FROM c)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, event_id) AS original_rank, row_number() OVER (PARTITION BY user_id ORDER BY round(s * factor, 9) DESC, event_id) AS final_rank, round(s * factor, 6) AS adjusted FROM f""",
)
def quality_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    factor = Q.quality_factor(F.col("event_id") % 30, kind == "view", kind == "search", F.col("event_id") % 7 == 0)
    r = Q.reranked(t(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") / 100, factor)
    return r.select("user_id", "event_id", "original_rank", "final_rank", F.round("adjusted", 6).alias("adjusted"))


@query("evidence_selection")
def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy evidence of each user with new facets only; sequential choice, tested on literals."""
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("item"), F.col("value").alias("score"), F.col("props").alias("text"), F.array("event_type").alias("facets"))
    return Q.chosen_evidence(e, "user_id")


@query(
    "groundedness_gate",
    """WITH a AS (SELECT user_id, count(*) FILTER (value > 150) AS pieces, count(*) FILTER (event_type = 'purchase') / count(*) AS coverage, user_id % 3 = 0 AS asks, count(DISTINCT event_type) >= 5 AS sides, user_id % 10 = 1 AS conflict FROM events GROUP BY user_id),
    r AS (SELECT user_id, CASE WHEN pieces < 1 THEN 'NO_EVIDENCE' WHEN conflict THEN 'CONFLICT' WHEN asks AND NOT sides THEN 'ONE_SIDE_ONLY' WHEN coverage < 0.5 THEN 'THIN_COVERAGE' END AS reason FROM a)
    SELECT user_id, CASE WHEN reason IS NULL THEN 'SUPPORTED' WHEN reason IN ('NO_EVIDENCE', 'CONFLICT') THEN 'ABSTAIN' ELSE 'PARTIAL' END AS status, reason FROM r""",
)
def groundedness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 150).alias("pieces"), (F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("coverage"), (F.countDistinct("event_type") >= 5).alias("sides"))
    status, reason = Q.gate(F.col("pieces"), F.col("coverage"), F.col("user_id") % 3 == 0, F.col("sides"), F.col("user_id") % 10 == 1)
    return a.select("user_id", status.alias("status"), reason.alias("reason"))


@query(
    "failure_attribution",
    """SELECT stage, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'RETRIEVAL' WHEN value < 20 THEN 'RERANK' WHEN event_id % 5 = 0 THEN 'SELECTION' WHEN user_id % 4 = 0 THEN 'GATE' ELSE 'SUCCESS' END AS stage FROM events) GROUP BY stage""",
)
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Q.failure_stage(F.col("event_type") != "view", F.col("value") >= 20, F.col("event_id") % 5 != 0, F.col("user_id") % 4 != 0)
    return t(spark, sf_dir, "events").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query(
    "accuracy_and_latency",
    """SELECT event_type, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(list_sort(list(value))[1 + least(floor(0.5 * count(*))::BIGINT, count(*) - 1)], 6) AS p50, round(list_sort(list(value))[1 + least(floor(0.95 * count(*))::BIGINT, count(*) - 1)], 6) AS p95 FROM events GROUP BY event_type""",
)
def accuracy_and_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 30).cast("double")), 6).alias("accuracy"), *[F.round(Q.floor_percentile(F.col("value"), p), 6).alias(f"p{p}") for p in (50, 95)])


@query(
    "sufficient_sets",
    """SELECT o_custkey, list_contains(list(DISTINCT o_orderstatus), 'F') AND list_contains(list(DISTINCT o_orderstatus), 'O') OR list_contains(list(DISTINCT o_orderstatus), 'P') AS recovered, list_sort(list(DISTINCT o_orderstatus))[1] AS first_status FROM orders GROUP BY 1""",
)
def sufficient_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.retrieval import recovered

    sets = F.array(F.array(F.lit("F"), F.lit("O")), F.array(F.lit("P")))
    s = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return s.select("o_custkey", recovered(F.col("s"), sets).alias("recovered"), F.get("s", F.lit(0)).alias("first_status"))


@query(
    "long_metrics",
    """SELECT supp, m.k AS category, round(m.e, 4) AS earlier, round(m.l, 4) AS later, round(m.l - m.e, 4) AS change FROM (SELECT l_suppkey AS supp, unnest([struct_pack(k := 'discount', e := avg(l_discount) FILTER (l_linenumber <= 2), l := avg(l_discount) FILTER (l_linenumber > 2)), struct_pack(k := 'tax', e := avg(l_tax) FILTER (l_linenumber <= 2), l := avg(l_tax) FILTER (l_linenumber > 2))]) AS m FROM lineitem GROUP BY 1)""",
)
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns of both sides as one row a category."""
    first = F.col("l_linenumber") <= 2
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(*[F.avg(F.when(first if s == "e" else ~first, F.col(f"l_{c}"))).alias(f"{c}_{s}") for c in ("discount", "tax") for s in "el"])
    items = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_e").alias("earlier"), F.col(f"{c}_l").alias("later")) for c in ("discount", "tax")])
    m = a.select("supp", F.explode(items).alias("m")).select("supp", "m.*")
    return m.select("supp", "category", F.round("earlier", 4).alias("earlier"), F.round("later", 4).alias("later"), F.round(F.col("later") - F.col("earlier"), 4).alias("change"))


@query(
    "language_sensitivity",
    """WITH v AS (SELECT source, s.k AS variant, s.keep AS keep, n_chars, digits FROM (SELECT source, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, unnest([struct_pack(k := 'all', keep := true), struct_pack(k := 'no_digits', keep := NOT regexp_matches(text, '[0-9]')), struct_pack(k := 'long', keep := n_chars >= 1000)]) AS s FROM documents))
    SELECT source, variant, count(*) FILTER (keep) AS n, coalesce(sum(n_chars) FILTER (keep), 0)::BIGINT AS chars, round(sum(n_chars) FILTER (NOT keep) / sum(n_chars), 6) AS lost FROM v GROUP BY 1, 2""",
)
def language_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate over filtered populations, each row read once."""
    keep = {"all": F.lit(True), "no_digits": ~F.col("text").rlike("[0-9]"), "long": F.col("n_chars") >= 1000}
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("keep")) for k, c in keep.items()]))
    d = t(spark, sf_dir, "documents").select("source", "n_chars", v.alias("v")).select("source", "n_chars", "v.variant", "v.keep")
    kept, lost = F.when(F.col("keep"), F.col("n_chars")), F.when(~F.col("keep"), F.col("n_chars"))
    return d.groupBy("source", "variant").agg(F.count_if("keep").alias("n"), F.coalesce(F.sum(kept), F.lit(0)).alias("chars"), F.round(F.sum(lost) / F.sum("n_chars"), 6).alias("lost"))
