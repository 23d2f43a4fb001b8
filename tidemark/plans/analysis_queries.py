"""Queries of vectors, alignment, change features, dictionary rates, ranked findings, evaluation and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import alignment as A
from tidemark.operators import features as C
from tidemark.operators import lexicon as L
from tidemark.operators import retrieval as R
from tidemark.operators import validation as V
from tidemark.operators import windows as W

from .registry import query
from .relational_queries import t
from .text_queries import TOKENS_SQL


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of a label by parity of their id: even earlier, odd later."""
    v = t(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    return v.where("idx % 2 = 0"), v.where("idx % 2 = 1")


CANDIDATES_SQL = """v AS (SELECT label AS run, vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT l.run, l.idx AS l_idx, r.idx AS e_idx, list_dot_product(l.e, r.e) / (sqrt(list_dot_product(l.e, l.e)) * sqrt(list_dot_product(r.e, r.e))) AS similarity FROM v l JOIN v r ON l.run = r.run AND l.idx % 2 = 1 AND r.idx % 2 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY run, l_idx ORDER BY round(similarity, 9) DESC, e_idx) AS candidate_rank FROM s QUALIFY candidate_rank <= 5)"""


@query("vector_topk_restricted", f"WITH {CANDIDATES_SQL} SELECT run, l_idx, e_idx, round(similarity, 6) AS similarity, candidate_rank FROM c WHERE similarity >= 0.2")
def vector_topk_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.candidates(*_sides(spark, sf_dir), "run", floor=0.2)
    return out.select("run", "l_idx", "e_idx", F.round("similarity", 6).alias("similarity"), F.col("candidate_rank").cast("long").alias("candidate_rank"))


@query(
    "best_second_margin",
    f"WITH {CANDIDATES_SQL} SELECT run, l_idx, e_idx, round(similarity - lead(similarity) OVER (PARTITION BY run, l_idx ORDER BY candidate_rank), 6) AS margin FROM c WHERE similarity >= 0.2",
)
def best_second_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.candidates(*_sides(spark, sf_dir), "run", floor=0.2)
    return c.select("run", "l_idx", "e_idx", F.round(W.best_second_margin(F.col("similarity"), ["run", "l_idx"], [F.col("candidate_rank")]), 6).alias("margin"))


@query("candidate_collisions", f"WITH {CANDIDATES_SQL} SELECT run, l_idx, e_idx, (count(*) FILTER (similarity >= 0.3) OVER (PARTITION BY run, e_idx) - (similarity >= 0.3)::BIGINT)::BIGINT AS rivals FROM c WHERE similarity >= 0.2")
def candidate_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.candidates(*_sides(spark, sf_dir), "run", floor=0.2).withColumnRenamed("similarity", "score")
    return A.collisions(c, "run", 0.3).select("run", "l_idx", "e_idx", "rivals")


@query("greedy_alignment")
def greedy_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, new, removed and ambiguous vectors of each label; sequential choice, tested against plain Python."""
    e, w = _sides(spark, sf_dir)
    proposals = A.candidates(e, w, "run", floor=0.2).withColumnRenamed("similarity", "score").select("run", "l_idx", "e_idx", "score")
    matches = A.assigned(proposals, "run", 0.3, claims=True)
    return A.assembled(e, w, matches, "run", A.split_flags(proposals, matches, "run"), A.merge_flags(proposals, matches, "run"))


MUTUAL_SQL = f"""{CANDIDATES_SQL},
p AS (SELECT run, l_idx, e_idx, similarity * 2.5 AS score FROM c WHERE similarity >= 0.2),
m AS (SELECT run, l_idx, e_idx, score FROM p QUALIFY row_number() OVER (PARTITION BY run, l_idx ORDER BY round(score, 9) DESC, e_idx) = 1 AND row_number() OVER (PARTITION BY run, e_idx ORDER BY round(score, 9) DESC, l_idx) = 1)"""


def _mutual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, scaled to the range that the bars are made for, and as matches the pairs that are each other's best."""
    p = A.candidates(*_sides(spark, sf_dir), "run", floor=0.2).select("run", "l_idx", "e_idx", (F.col("similarity") * 2.5).alias("score"))
    best = lambda own, other: F.row_number().over(Window.partitionBy("run", own).orderBy(F.desc(F.round("score", 9)), other))
    return p, p.withColumn("_l", best("l_idx", "e_idx")).withColumn("_e", best("e_idx", "l_idx")).where("_l = 1 and _e = 1").select("run", "l_idx", "e_idx", "score")


BAR_SQL = "CASE WHEN abs({a} - {b}) <= 3 THEN p.score >= 0.35 ELSE p.score >= 0.65 END"
FLAGS_SQL = f"""{MUTUAL_SQL},
sp AS (SELECT p.run, p.l_idx, p.e_idx AS split_of, m.l_idx AS owner FROM p JOIN m ON p.run = m.run AND p.e_idx = m.e_idx WHERE (p.run, p.l_idx) NOT IN (SELECT (run, l_idx) FROM m) AND {BAR_SQL.format(a="p.l_idx", b="m.l_idx")} QUALIFY row_number() OVER (PARTITION BY p.run, p.l_idx ORDER BY p.score DESC, p.e_idx) = 1),
mg AS (SELECT p.run, p.e_idx, p.l_idx AS merged_into, m.e_idx AS owner FROM p JOIN m ON p.run = m.run AND p.l_idx = m.l_idx WHERE (p.run, p.e_idx) NOT IN (SELECT (run, e_idx) FROM m) AND {BAR_SQL.format(a="p.e_idx", b="m.e_idx")} QUALIFY row_number() OVER (PARTITION BY p.run, p.e_idx ORDER BY p.l_idx) = 1)"""


@query(
    "split_and_merge",
    f"""WITH {FLAGS_SQL} SELECT run, 'SPLIT' AS kind, l_idx AS idx, split_of AS other, owner, 'likely split (' || CASE WHEN abs(l_idx - owner) = 1 THEN 'adjacent' ELSE abs(l_idx - owner) || ' passages apart' END || '): also matches the earlier passage taken by later passage ' || owner AS note FROM sp
    UNION ALL SELECT run, 'MERGE', e_idx, merged_into, owner, 'likely merge (' || CASE WHEN abs(e_idx - owner) = 1 THEN 'adjacent' ELSE abs(e_idx - owner) || ' passages apart' END || '): also proposed for the later passage matched to earlier passage ' || owner FROM mg""",
)
def split_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = _mutual(spark, sf_dir)
    s = A.split_flags(p, m, "run").select("run", F.lit("SPLIT").alias("kind"), F.col("l_idx").alias("idx"), F.col("split_of").alias("other"), "owner", "note")
    return s.unionByName(A.merge_flags(p, m, "run").select("run", F.lit("MERGE").alias("kind"), F.col("e_idx").alias("idx"), F.col("merged_into").alias("other"), "owner", "note"))


@query(
    "collision_notes",
    f"""WITH {MUTUAL_SQL}, e AS (SELECT label AS run, vec_id AS idx, vec_id % 64 AS digest FROM embeddings WHERE vec_id % 2 = 0),
    d AS (SELECT run, idx, count(*) OVER (PARTITION BY run, digest) > 1 AS twice FROM e),
    r AS (SELECT m.run, m.l_idx, (SELECT count(DISTINCT p.l_idx) FROM p WHERE p.run = m.run AND p.e_idx = m.e_idx AND p.l_idx <> m.l_idx AND p.score >= 0.45) AS rivals, d.twice AS duplicated FROM m JOIN d ON d.run = m.run AND d.idx = m.e_idx)
    SELECT *, CASE WHEN rivals > 0 THEN 'earlier passage also proposed by ' || rivals || ' other later passages, match may be arbitrary' ELSE 'earlier passage duplicates another earlier one, match cannot be disambiguated' END AS note FROM r WHERE rivals > 0 OR duplicated""",
)
def collision_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = _mutual(spark, sf_dir)
    e = _sides(spark, sf_dir)[0].withColumn("digest", F.col("idx") % 64)
    return A.collision_flags(p, m, e, "run")


@query(
    "alignment_runs",
    f"""WITH {FLAGS_SQL}, a AS (
      SELECT v.run, CASE WHEN m.e_idx IS NOT NULL THEN 'MATCHED' WHEN sp.l_idx IS NOT NULL THEN 'AMBIGUOUS' ELSE 'NEW' END AS status FROM v LEFT JOIN m ON m.run = v.run AND m.l_idx = v.idx LEFT JOIN sp ON sp.run = v.run AND sp.l_idx = v.idx WHERE v.idx % 2 = 1
      UNION ALL SELECT v.run, CASE WHEN mg.e_idx IS NOT NULL THEN 'AMBIGUOUS' ELSE 'REMOVED' END FROM v LEFT JOIN mg ON mg.run = v.run AND mg.e_idx = v.idx WHERE v.idx % 2 = 0 AND (v.run, v.idx) NOT IN (SELECT (run, e_idx) FROM m)),
    g AS (SELECT run, count(*) FILTER (status = 'MATCHED') AS matched_count, count(*) FILTER (status = 'NEW') AS new_count, count(*) FILTER (status = 'REMOVED') AS removed_count, count(*) FILTER (status = 'AMBIGUOUS') AS ambiguous_count FROM a GROUP BY 1),
    w AS (SELECT *, nullif(concat_ws('; ', CASE WHEN run % 3 = 0 THEN 'source extraction quality NEEDS_REVIEW on at least one side' END, CASE WHEN run % 4 = 1 THEN 'transition-period pair' END, CASE WHEN run * 3 > 18 THEN 'irregular reporting gap (' || run * 3 || ' months)' END, CASE WHEN ambiguous_count > 0 THEN ambiguous_count || ' ambiguous alignment(s)' END), '') AS review_reason FROM g)
    SELECT *, CASE WHEN review_reason IS NULL THEN 'COMPLETED' ELSE 'COMPLETED_WITH_WARNINGS' END AS run_status FROM w""",
)
def alignment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and warnings of each label's alignment; matches are the pairs that are each other's best, as SQL can state them."""
    e, w = _sides(spark, sf_dir)
    p, m = _mutual(spark, sf_dir)
    rows = A.assembled(e, w, m, "run", A.split_flags(p, m, "run"), A.merge_flags(p, m, "run"))
    pairs = t(spark, sf_dir, "embeddings").select(F.col("label").alias("run")).distinct()
    pairs = pairs.select("run", F.when(F.col("run") % 3 == 0, F.lit("NEEDS_REVIEW")).otherwise(F.lit("GOOD")).alias("earlier_quality"), F.lit("GOOD").alias("later_quality"), (F.col("run") % 4 == 1).alias("is_transition"), (F.col("run") * 3).alias("gap_months"))
    return A.run_summary(rows, pairs, "run").select("run", "matched_count", "new_count", "removed_count", "ambiguous_count", "review_reason", "run_status")


@query(
    "zero_vectors",
    "SELECT label, count(*) AS n, count(*) FILTER (sqrt(list_dot_product(e, e)) < 1e-9) AS zero, round(min(sqrt(list_dot_product(e, e))), 6) AS least_norm, min(len(e)) AS dims FROM (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) GROUP BY label",
)
def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.norm(F.col("embedding"))
    return t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(n < 1e-9).alias("zero"), F.round(F.min(n), 6).alias("least_norm"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query(
    "vector_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT b.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM v a JOIN v b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY similarity DESC, b.vec_id LIMIT 10""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of one vector: a bounded top-k, no sort of everything."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = v.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", F.round(N.cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(10)


ROWS_SQL = """rows AS (SELECT l_suppkey AS pair, CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'LIGHTLY_MODIFIED' WHEN 2 THEN 'SUBSTANTIALLY_MODIFIED' WHEN 3 THEN 'NEW' WHEN 4 THEN 'REMOVED' ELSE 'AMBIGUOUS' END AS status,
  CASE WHEN (l_orderkey + l_linenumber) % 6 <> 3 THEN (l_quantity * 4)::BIGINT END AS earlier_words, CASE WHEN (l_orderkey + l_linenumber) % 6 <> 4 THEN (l_quantity * 3)::BIGINT END AS later_words FROM lineitem)"""


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int")
    statuses = F.array(*[F.lit(s) for s in C.WEIGHTS])
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair"), F.get(statuses, k).alias("status"), F.when(k != 3, (F.col("l_quantity") * 4).cast("long")).alias("earlier_words"), F.when(k != 4, (F.col("l_quantity") * 3).cast("long")).alias("later_words")
    )


def _score_sql() -> str:
    weight = "CASE WHEN status = 'NEW' THEN later_words WHEN status = 'REMOVED' THEN earlier_words WHEN status = 'AMBIGUOUS' THEN coalesce(earlier_words, later_words) ELSE (earlier_words + later_words) / 2.0 END::DOUBLE"
    ok = "(coalesce(earlier_words >= 40, true) AND coalesce(later_words >= 40, true))"
    words = ", ".join(f"coalesce(sum({weight}) FILTER (status = '{s}' AND {ok}), 0) AS {s.lower()}" for s in C.WEIGHTS)
    counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}_count" for s in C.WEIGHTS)
    total = " + ".join(s.lower() for s in C.WEIGHTS)
    score = " + ".join(f"{s.lower()} / ({total}) * {w}" for s, w in C.WEIGHTS.items())
    names = ", ".join(f"{s.lower()}_count" for s in C.WEIGHTS)
    matched = "status IN ('UNCHANGED', 'LIGHTLY_MODIFIED', 'SUBSTANTIALLY_MODIFIED')"
    both = "coalesce(earlier_words, 0) + coalesce(later_words, 0)"
    return f"""WITH {ROWS_SQL}, o AS (SELECT pair, {words}, {counts}, sum(CASE WHEN {matched} THEN {both} ELSE 0 END) / nullif(sum({both}), 0) AS coverage FROM rows GROUP BY pair)
    SELECT pair, {names}, round(CASE WHEN {total} <> 0 THEN lightly_modified / ({total}) END, 6) AS lightly_modified_rate, round(coverage, 6) AS coverage_words,
      round(CASE WHEN {total} <> 0 AND coverage >= 0.45 THEN greatest(0.0, least(1.0, {score})) END, 6) AS change_score FROM o"""


@query("outcome_rates_score", _score_sql())
def outcome_rates_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_rows(spark, sf_dir)
    o = C.outcomes(rows, ["pair"]).join(C.coverage(rows, ["pair"]), "pair")
    r = C.rates()
    total = sum((r[s] * w for s, w in C.WEIGHTS.items()), F.lit(0.0))
    score = F.when(total.isNotNull() & (F.col("coverage_words") >= 0.45), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return o.select("pair", *[f"{s.lower()}_count" for s in C.WEIGHTS], F.round(r["LIGHTLY_MODIFIED"], 6).alias("lightly_modified_rate"), F.round("coverage_words", 6).alias("coverage_words"), F.round(score, 6).alias("change_score"))


@query(
    "feature_quality",
    f"""WITH {ROWS_SQL}, o AS (SELECT pair, round(count(*) FILTER (status = 'AMBIGUOUS') / count(*), 9) AS a, round(count(*) FILTER (status IN ('UNCHANGED', 'LIGHTLY_MODIFIED', 'SUBSTANTIALLY_MODIFIED')) / count(*), 9) AS c, round(avg(CASE WHEN later_words < 40 THEN 1.0 ELSE 0.0 END), 9) AS lo, (pair % 24)::BIGINT AS gap FROM rows GROUP BY pair),
    q AS (SELECT *, nullif(concat_ws('; ', CASE WHEN c < 0.8 THEN 'insufficient coverage' END, CASE WHEN a > 0.15 THEN 'many ambiguous alignments' END, CASE WHEN lo > 0.25 THEN 'many low-confidence alignments' END, CASE WHEN NOT gap BETWEEN 9 AND 15 THEN 'irregular gap' END), '') AS reasons FROM o)
    SELECT pair, CASE WHEN reasons IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS quality, reasons FROM q""",
)
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = change_rows(spark, sf_dir).groupBy("pair").agg(
        F.round(F.count_if(F.col("status") == "AMBIGUOUS") / F.count("*"), 9).alias("a"), F.round(F.count_if(F.col("status").isin(*C.MATCHED)) / F.count("*"), 9).alias("c"), F.round(F.avg(F.when(F.col("later_words") < 40, 1.0).otherwise(0.0)), 9).alias("lo")
    )
    quality, reasons = C.feature_quality(F.col("c"), F.col("a"), F.col("lo"), F.col("pair") % 24, F.lit("GOOD"))
    return o.select("pair", quality.alias("quality"), reasons.alias("reasons"))


@query(
    "alignment_classes",
    f"""WITH {CANDIDATES_SQL}, m AS (SELECT *, similarity - lead(similarity) OVER (PARTITION BY run, l_idx ORDER BY candidate_rank) AS margin, (e_idx % 100) / 100.0 AS lexical, (l_idx % 50 + 50) / 100.0 AS length FROM c)
    SELECT run, l_idx, e_idx, CASE WHEN similarity >= 0.95 AND lexical >= 0.9 AND length >= 0.85 THEN 'UNCHANGED' WHEN similarity >= 0.85 THEN 'LIGHTLY_MODIFIED' ELSE 'SUBSTANTIALLY_MODIFIED' END AS status,
      CASE WHEN similarity >= 0.85 AND lexical <= 0.40 THEN 'high semantic, low lexical' WHEN similarity <= 0.55 AND lexical >= 0.75 THEN 'low semantic, high lexical' END AS note,
      CASE WHEN (similarity >= 0.85 AND lexical <= 0.40) OR (similarity <= 0.55 AND lexical >= 0.75) THEN 'NEEDS_REVIEW' WHEN coalesce(margin, 1.0) < 0.03 THEN 'LOW' WHEN coalesce(margin, 1.0) < 0.08 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM m""",
)
def alignment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.candidates(*_sides(spark, sf_dir), "run", floor=-1.0)
    c = c.withColumn("margin", W.best_second_margin(F.col("similarity"), ["run", "l_idx"], [F.col("candidate_rank")]))
    lexical, length = (F.col("e_idx") % 100) / 100.0, (F.col("l_idx") % 50 + 50) / 100.0
    note = C.disagreement(F.col("similarity"), lexical)
    return c.select("run", "l_idx", "e_idx", C.alignment_status(F.col("similarity"), lexical, length).alias("status"), note.alias("note"), C.alignment_confidence(F.col("margin"), note).alias("confidence"))


#: A lexicon of words that occur in the invented texts.
WORDS = [("the", "definite"), ("that", "definite"), ("with", "relation"), ("from", "relation"), ("no", "negation"), ("la", "definite"), ("de", "relation"), ("und", "relation"), ("of the", "phrase"), ("in the", "phrase")]
LEXICON_SQL = "lex(term, category) AS (VALUES ('the', 'definite'), ('that', 'definite'), ('with', 'relation'), ('from', 'relation'), ('no', 'negation'), ('la', 'definite'), ('de', 'relation'), ('und', 'relation'))"


@query(
    "dictionary_rates",
    f"""WITH {LEXICON_SQL}, tk AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), n AS (SELECT doc_id, count(*) AS words FROM tk GROUP BY 1)
    SELECT doc_id, category, count(*) AS hits, round(count(*) * 1000 / any_value(words), 6) AS rate FROM tk JOIN lex USING (term) JOIN n USING (doc_id) GROUP BY 1, 2""",
)
def dictionary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tk"))
    lexicon = spark.createDataFrame([w for w in WORDS if " " not in w[0]], "term string, category string")
    return L.rates(L.word_hits(d, "doc_id", "tk", lexicon), d.select("doc_id", F.size("tk").alias("words")), "doc_id").select("doc_id", "category", "hits", F.round("rate", 6).alias("rate"))


@query(
    "net_tone_change",
    f"""WITH {LEXICON_SQL}, tk AS (SELECT source, doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
    r AS (SELECT source, doc_id, 1000 * count(*) FILTER (category = 'definite') / count(*) - 1000 * count(*) FILTER (category = 'relation') / count(*) AS tone FROM tk LEFT JOIN lex USING (term) GROUP BY 1, 2)
    SELECT source, doc_id, round(tone, 6) AS net_tone, round(tone - lag(tone) OVER (PARTITION BY source ORDER BY doc_id), 6) AS net_tone_change FROM r""",
)
def net_tone_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame([w for w in WORDS if " " not in w[0]], "term string, category string")
    words = t(spark, sf_dir, "documents").select("source", "doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    hit = words.join(F.broadcast(lexicon), "term", "left")
    share = lambda c: N.rate_per(F.count_if(F.col("category") == c), F.count("*"))
    tone = hit.groupBy("source", "doc_id").agg(L.net_tone(share("definite"), share("relation")).alias("tone"))
    before = F.lag("tone").over(Window.partitionBy("source").orderBy("doc_id"))
    return tone.select("source", "doc_id", F.round("tone", 6).alias("net_tone"), F.round(F.col("tone") - before, 6).alias("net_tone_change"))


@query("phrase_negation_hits")
def phrase_negation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases before words, with negation; sequential matching, tested on literals."""
    return L.signals(t(spark, sf_dir, "documents"), "doc_id", "text", WORDS)


@query(
    "top3_findings",
    """WITH u AS (SELECT l_suppkey AS pair, unnest([struct_pack(k := 'discount', o := 1, v := avg(l_discount) - 0.05, e := 0.0005), struct_pack(k := 'tax', o := 2, v := avg(l_tax) - 0.04, e := 0.0005), struct_pack(k := 'quantity', o := 3, v := avg(l_quantity) / 1000 - 0.025, e := 0.0002), struct_pack(k := 'returned', o := 4, v := count(*) FILTER (l_returnflag = 'R') / count(*) - 0.33, e := 0.01)]) AS s FROM lineitem GROUP BY 1),
    r AS (SELECT pair, s.k AS k, row_number() OVER (PARTITION BY pair ORDER BY round(abs(s.v), 9) DESC, s.o) AS n FROM u WHERE abs(s.v) > s.e)
    SELECT l.pair, max(k) FILTER (n = 1) AS first_finding, max(k) FILTER (n = 2) AS second_finding, max(k) FILTER (n = 3) AS third_finding FROM (SELECT DISTINCT l_suppkey AS pair FROM lineitem) l LEFT JOIN r USING (pair) GROUP BY 1""",
)
def top3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair")).agg(
        (F.avg("l_discount") - 0.05).alias("discount"), (F.avg("l_tax") - 0.04).alias("tax"), (F.avg("l_quantity") / 1000 - 0.025).alias("quantity"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*") - 0.33).alias("returned")
    )
    return V.top_findings(m, "pair", {"discount": 0.0005, "tax": 0.0005, "quantity": 0.0002, "returned": 0.01})


IR_SQL = """WITH ranked AS (SELECT user_id AS case_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
judged AS (SELECT user_id AS case_id, event_id AS id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS gain FROM events),
j AS (SELECT r.case_id, r.rank, coalesce(g.gain, 0) AS gain FROM ranked r LEFT JOIN judged g USING (case_id, id) WHERE r.rank <= 10),
got AS (SELECT case_id, count(*) AS n, count(*) FILTER (gain > 0) AS hits, min(rank) FILTER (gain > 0) AS f, sum((2.0 ** gain - 1) / log2(rank + 1)) AS dcg FROM j GROUP BY 1),
ideal AS (SELECT case_id, count(*) AS relevant, sum(CASE WHEN p <= 10 THEN (2.0 ** gain - 1) / log2(p + 1) END) AS best FROM (SELECT case_id, gain, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, id) AS p FROM judged WHERE gain > 0) GROUP BY 1)
SELECT case_id, round(CASE WHEN coalesce(relevant, 0) = 0 THEN 1.0 ELSE hits / relevant END, 6) AS recall, round(hits / n, 6) AS precision, round(coalesce(1.0 / f, 0), 6) AS reciprocal_rank, round(dcg / best, 6) AS ndcg FROM got LEFT JOIN ideal USING (case_id)"""


@query("ir_metrics", IR_SQL)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    ranked = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    gain = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 1).otherwise(0)
    judged = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("id"), gain.alias("gain"))
    m = R.measures(ranked, judged, 10)
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")])


@query(
    "publication_checks",
    """SELECT * FROM (VALUES
      ('orders_unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))),
      ('lines_have_orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))),
      ('orders_have_customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))),
      ('lines_contiguous', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))))),
      ('labels_have_documents', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))),
      ('statuses_known', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')))) v(check_name, failures)""",
)
def publication_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, cu, la, d = (t(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "labels", "documents"))
    return V.report(
        {
            "orders_unique": V.repeated(o, ["o_orderkey"]), "lines_have_orders": V.orphans(li, "l_orderkey", o, "o_orderkey"), "orders_have_customers": V.orphans(o, "o_custkey", cu, "c_custkey"),
            "lines_contiguous": V.not_contiguous(li, ["l_orderkey"], "l_linenumber", 1), "labels_have_documents": V.orphans(la, "doc_id", d, "doc_id"), "statuses_known": o.where(~F.col("o_orderstatus").isin("F", "O", "P")),
        }
    )


@query(
    "repeated_lines",
    """WITH l AS (SELECT source, doc_id, i, n, regexp_replace(regexp_replace(lower(trim(lines[i])), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g') AS norm FROM (SELECT source, doc_id, lines, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))),
    e AS (SELECT source, CASE WHEN i = 1 THEN 'header' ELSE 'footer' END AS band, norm, doc_id FROM l WHERE (i = 1 OR i = n) AND norm <> '')
    SELECT source, band, norm, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 2""",
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that recur in a source, as recurring headers and footers do."""
    lines = t(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    edge = F.array(F.struct(F.lit("header").alias("band"), F.get("lines", F.lit(0)).alias("line")), F.struct(F.when(F.size("lines") > 1, F.lit("footer")).alias("band"), F.element_at("lines", -1).alias("line")))
    e = lines.select("source", "doc_id", F.explode(edge).alias("e")).where("e.band is not null").select("source", "doc_id", "e.band", T.header_form(F.col("e.line")).alias("norm")).where("norm <> ''")
    return e.groupBy("source", "band", "norm").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 2")
