"""Queries over consecutive documents of a source: what changed, by how much, and how sure that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators import similarity as S

from .registry import query
from .text_queries import TOKENS_SQL

PAIRS_SQL = f"""tokened AS (SELECT source, doc_id, text, {TOKENS_SQL} AS tk, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents),
pairs AS (SELECT * FROM (SELECT source, doc_id AS earlier_doc_id, lead(doc_id) OVER w AS later_doc_id, tk AS etk, lead(tk) OVER w AS ltk, words AS earlier_words, lead(words) OVER w AS later_words,
  length(text)::BIGINT AS earlier_chars, lead(length(text)::BIGINT) OVER w AS later_chars, sha256(text) AS earlier_hash, lead(sha256(text)) OVER w AS later_hash
  FROM tokened WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE later_doc_id IS NOT NULL)"""
COSINE_SQL = """ea AS (SELECT earlier_doc_id AS k, t, 1 + ln(count(*)) AS wa FROM (SELECT earlier_doc_id, unnest(etk) AS t FROM pairs) GROUP BY ALL),
la AS (SELECT earlier_doc_id AS k, t, 1 + ln(count(*)) AS wb FROM (SELECT earlier_doc_id, unnest(ltk) AS t FROM pairs) GROUP BY ALL),
cosines AS (SELECT coalesce(ea.k, la.k) AS k, CASE WHEN bool_and(coalesce(wa = wb, false)) THEN 1.0 WHEN sum(wa * wa) IS NULL OR sum(wb * wb) IS NULL THEN NULL
  ELSE greatest(0.0, least(1.0, coalesce(sum(wa * wb), 0) / sqrt(sum(wa * wa) * sum(wb * wb)))) END AS lexical_cosine
  FROM ea FULL JOIN la ON ea.k = la.k AND ea.t = la.t GROUP BY coalesce(ea.k, la.k))"""
BIGRAMS_SQL = """grams AS (SELECT earlier_doc_id AS k, CASE WHEN len(etk) < 2 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(etk)), lambda i: etk[i] || ' ' || etk[i + 1])) END AS a,
  CASE WHEN len(ltk) < 2 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(ltk)), lambda i: ltk[i] || ' ' || ltk[i + 1])) END AS b FROM pairs),
jaccards AS (SELECT k, CASE WHEN len(a) + len(b) = 0 THEN NULL ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS bigram_jaccard FROM grams)"""


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text")
    t = F.col("text")
    d = d.select("source", "doc_id", S.hashed(T.tokens(t)).alias("tk"), T.word_count(t).alias("words"), F.length(t).cast("long").alias("chars"), T.content_hash(t).alias("hash"))
    return S.consecutive(d, "source", "doc_id", ["tk", "words", "chars", "hash"])


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_of(spark, sf_dir)
    change, share = S.length_change(F.col("earlier_words"), F.col("later_words"))
    jaccard = S.jaccard(S.hashed_bigrams(F.col("earlier_tk")), S.hashed_bigrams(F.col("later_tk")))
    scored = pairs.select("source", "earlier_doc_id", "later_doc_id", "earlier_words", "later_words", change.alias("word_change"), share.alias("word_change_ratio"), jaccard.alias("bigram_jaccard"), "earlier_tk", "later_tk")
    return S.with_term_cosine(scored, "earlier_tk", "later_tk")


MOST_CHANGED_SQL = f"""WITH {PAIRS_SQL}, {COSINE_SQL}, {BIGRAMS_SQL}
SELECT source, earlier_doc_id, later_doc_id, earlier_words, later_words, round(CASE WHEN earlier_words <> 0 THEN (later_words - earlier_words) / earlier_words END, 10) AS word_change_ratio,
  round(lexical_cosine, 6) AS lexical_cosine, round(bigram_jaccard, 6) AS bigram_jaccard,
  row_number() OVER (ORDER BY round(lexical_cosine, 9), earlier_doc_id, later_doc_id)::BIGINT AS change_rank
FROM pairs JOIN cosines c ON c.k = earlier_doc_id JOIN jaccards j ON j.k = earlier_doc_id WHERE lexical_cosine IS NOT NULL"""


@query("most_changed_documents", MOST_CHANGED_SQL)
def most_changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which consecutive documents of a source changed most."""
    scored = scored_pairs(spark, sf_dir).withColumn("by", F.round("lexical_cosine", 9))
    ranked = S.most_changed(scored, "by", ["earlier_doc_id", "later_doc_id"])
    return ranked.select("source", "earlier_doc_id", "later_doc_id", "earlier_words", "later_words", F.round("word_change_ratio", 10).alias("word_change_ratio"), F.round("lexical_cosine", 6).alias("lexical_cosine"), F.round("bigram_jaccard", 6).alias("bigram_jaccard"), "change_rank")


@query(
    "length_change_pairs",
    f"""WITH {PAIRS_SQL} SELECT source, earlier_doc_id, later_doc_id, later_words - earlier_words AS word_change, round(CASE WHEN earlier_words <> 0 THEN (later_words - earlier_words) / earlier_words END, 10) AS word_change_ratio,
    later_chars - earlier_chars AS char_change, round(CASE WHEN earlier_chars <> 0 THEN (later_chars - earlier_chars) / earlier_chars END, 10) AS char_change_ratio, earlier_hash = later_hash AS same_text FROM pairs""",
)
def length_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, wr = S.length_change(F.col("earlier_words"), F.col("later_words"))
    c, cr = S.length_change(F.col("earlier_chars"), F.col("later_chars"))
    return pairs_of(spark, sf_dir).select("source", "earlier_doc_id", "later_doc_id", w.alias("word_change"), F.round(wr, 10).alias("word_change_ratio"), c.alias("char_change"), F.round(cr, 10).alias("char_change_ratio"), (F.col("earlier_hash") == F.col("later_hash")).alias("same_text"))


@query("sequence_and_edit_similarity")
def sequence_and_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence ratio and token edit similarity of consecutive documents; quadratic in the tokens of a pair, not in pairs."""
    return S.token_metrics(pairs_of(spark, sf_dir), "earlier_doc_id", "earlier_tk", "later_tk")


@query(
    "similarity_quality",
    f"""WITH {PAIRS_SQL}, {COSINE_SQL}, {BIGRAMS_SQL}, q AS (SELECT earlier_doc_id, earlier_words, later_words, lexical_cosine, bigram_jaccard,
      CASE WHEN earlier_words < 200 OR later_words < 200 THEN 'short document' END AS r1,
      CASE WHEN greatest(earlier_words, later_words) > 3.0 * least(earlier_words, later_words) THEN 'extreme length ratio' END AS r2,
      CASE WHEN lexical_cosine IS NULL OR bigram_jaccard IS NULL THEN 'missing metric' END AS r3,
      CASE WHEN round(greatest(lexical_cosine, bigram_jaccard) - least(lexical_cosine, bigram_jaccard), 9) > 0.4 THEN 'metrics disagree' END AS r4
      FROM pairs JOIN cosines c ON c.k = earlier_doc_id JOIN jaccards j ON j.k = earlier_doc_id)
    SELECT earlier_doc_id, CASE WHEN lexical_cosine IS NULL AND bigram_jaccard IS NULL THEN 'FAILED' WHEN coalesce(r1, r2, r3, r4) IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS quality_status,
      nullif(concat_ws('; ', r1, r2, r3, r4), '') AS review_reason, coalesce(r1, r2, r3) IS NULL AS primary_eligible FROM q""",
)
def similarity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_pairs(spark, sf_dir)
    e, lw, c, j = (F.col(x) for x in ("earlier_words", "later_words", "lexical_cosine", "bigram_jaccard"))
    checks = [
        F.when((e < 200) | (lw < 200), F.lit("short document")), F.when(F.greatest(e, lw) > 3.0 * F.least(e, lw), F.lit("extreme length ratio")),
        F.when(c.isNull() | j.isNull(), F.lit("missing metric")), F.when(F.round(N.spread(c, j), 9) > 0.4, F.lit("metrics disagree")),
    ]
    reason = T.reasons(*checks)
    status = F.when(c.isNull() & j.isNull(), F.lit("FAILED")).when(reason.isNotNull(), F.lit("NEEDS_REVIEW")).otherwise(F.lit("GOOD"))
    return s.select("earlier_doc_id", status.alias("quality_status"), reason.alias("review_reason"), T.reasons(*checks[:3]).isNull().alias("primary_eligible"))


@query(
    "content_hash_collisions",
    """SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY sha256(text) HAVING count(*) > 1""",
)
def content_hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.countDistinct("source").alias("n_sources")).where("n > 1")
