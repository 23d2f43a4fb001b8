"""Queries of text scalars over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


TOKENS_SQL = r"regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:[''’-]\p{L}+)*[''’]?', 0)"
CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
  '([a-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g'), '\n{2,}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(
    "token_counts",
    rf"""SELECT doc_id, len(tk)::BIGINT AS n_tokens, len(list_distinct(tk))::BIGINT AS n_terms, coalesce(array_to_string(tk[1:5], ' '), '') AS first_tokens
    FROM (SELECT doc_id, {TOKENS_SQL} AS tk FROM documents)""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("long").alias("n_terms"), F.array_join(F.slice("tk", 1, 5), " ").alias("first_tokens"))


@query(
    "doc_stats",
    r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words,
    CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\p{Nd}]', '', 'g')) / length(text), 6) END AS digit_share,
    CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text), 6) END AS letter_share,
    len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))::BIGINT AS n_sentences,
    sha256(text) AS content_hash FROM documents""",
)
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", T.word_count(t).alias("n_words"), F.round(T.share_of(t, "Nd"), 6).alias("digit_share"), F.round(T.share_of(t, "L"), 6).alias("letter_share"),
        F.size(T.sentences(t)).cast("long").alias("n_sentences"), T.content_hash(t).alias("content_hash"),
    )


@query("clean_text", f"SELECT doc_id, c AS cleaned, length(c)::BIGINT AS n FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned")).withColumn("n", F.length("cleaned").cast("long"))


@query(
    "header_normal_form",
    r"""SELECT norm, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM (
      SELECT doc_id, regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\s+', ' ', 'g') AS norm
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY norm HAVING count(DISTINCT doc_id) >= 2""",
)
def header_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.header_form(F.col("line")).alias("norm")).agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 2")


@query(
    "text_flags",
    r"""SELECT doc_id, len(g) > len(list_distinct(g)) AS repeats_phrase, round(CASE WHEN len(p) = 0 THEN 1.0 ELSE len(list_filter(p, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) <= 3)) / len(p) END, 6) AS fragment_share,
      trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS normal_form, CASE WHEN length(text) > 320 THEN rtrim(text[1:320], ' ') || '…' ELSE text END AS truncated
    FROM (SELECT doc_id, text, CASE WHEN len(w) < 4 THEN [] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS g,
      list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p
      FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents))""",
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", T.repeats_phrase(t).alias("repeats_phrase"), F.round(T.fragment_share(t), 6).alias("fragment_share"), T.normal_form(t).alias("normal_form"), T.truncated(t).alias("truncated"))


@query(
    "inflections",
    r"""SELECT term, CASE WHEN regexp_matches(term, '(s|x|z|ch|sh)$') THEN term || 'es' WHEN regexp_matches(term, '[^aeiou]y$') THEN regexp_replace(term, 'y$', 'ies') ELSE term || 's' END AS plural_form,
      CASE WHEN regexp_matches(term, 'ize$') THEN regexp_replace(term, 'ize$', 'ise') END AS spelling, n FROM (
      SELECT t AS term, count(*) AS n FROM (SELECT unnest(tk) AS t FROM (SELECT """
    + TOKENS_SQL
    + r""" AS tk FROM documents WHERE lang = 'en')) WHERE regexp_full_match(t, '\p{L}+') GROUP BY t)""",
)
def inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _documents(spark, sf_dir).where("lang = 'en'").select(F.explode(T.tokens(F.col("text"))).alias("term")).where(F.col("term").rlike(r"^\p{L}+$")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.select("term", T.plural(F.col("term")).alias("plural_form"), F.get(T.spellings(F.col("term")), F.lit(0)).alias("spelling"), "n")


@query(
    "excerpts",
    r"""SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(text[s:s + 319]) || CASE WHEN s + 320 <= length(text) THEN '…' ELSE '' END AS excerpt
      FROM (SELECT doc_id, text, greatest(greatest(instr(lower(text), 'with'), 1) - 120, 1) AS s FROM documents WHERE contains(lower(text), 'with'))""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("with")))
    return d.select("doc_id", T.excerpt(F.col("text"), F.lit("with")).alias("excerpt"))


@query(
    "query_terms",
    r"""SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '["“”]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2))), ' OR '), '') AS any_terms
      FROM conversations WHERE role = 'user'""",
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return c.select("conv_id", "turn", T.any_of(F.array_sort(T.query_terms(F.col("text")))).alias("any_terms"))


@query(
    "url_parts",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '//[^/@]*@', '//'), '[?#].*$', '') AS plain_url,
      lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host, array_to_string([regexp_extract(url, '//([^/:?#]*)', 1), '2024', 'p. ' || (page_id % 9)], ', ') AS citation FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "//([^/:?#]*)", 1)
    page = F.col("page_id") % 9
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.redacted_url(F.col("url")).alias("plain_url"), F.lower(host).alias("host"), T.citation(host, F.lit(2024), page, page).alias("citation"))
