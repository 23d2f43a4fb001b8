"""Queries of blocks, passages, chunks, page quality, links and keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import features as C
from tidemark.operators import passages as P
from tidemark.operators import search as S
from tidemark.operators import windows as W
from tidemark.sources import files

from .registry import query
from .relational_queries import t
from .text_queries import TOKENS_SQL

LINES_SQL = "lines AS (SELECT doc_id, i::BIGINT AS i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
TYPE_SQL = r"""CASE WHEN length(li) = 0 THEN 'EMPTY' WHEN wo <= 6 AND (regexp_matches(li, '(?i)^(?:page\s+)?[0-9]{1,4}(?:\s*(?:of|/)\s*[0-9]{1,4})?$') OR length(li) <= 5 AND regexp_matches(li, '(?i)^m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$')) THEN 'PAGE_NUMBER'
  WHEN wo <= 3 AND (regexp_matches(li, '(?i)^(?:https?://|www\.)\S+$') OR le < 0.3 AND di < 0.3) THEN 'DECORATIVE' WHEN regexp_matches(li, '^\p{L}$') THEN 'DECORATIVE' WHEN di >= 0.30 AND nu >= 3 THEN 'TABLE_LIKE' WHEN di >= 0.5 AND wo <= 8 THEN 'NUMERIC_FRAGMENT'
  WHEN regexp_matches(li, '^\s*(?:[-•●▪*]|[0-9]+[.)])\s+') THEN 'LIST_ITEM' WHEN wo <= 12 AND NOT regexp_matches(li, '[.!?]\s*$') AND (regexp_matches(li, '\p{Lu}') AND NOT regexp_matches(li, '\p{Ll}') OR NOT regexp_matches(li, '[.;:,|]\s*$')) THEN 'HEADING' ELSE 'PARAGRAPH' END"""
BLOCKS_SQL = rf"""{LINES_SQL}, m AS (SELECT *, CASE WHEN length(li) = 0 THEN 0.0 ELSE length(regexp_replace(li, '[^\p{{Nd}}]', '', 'g')) / length(li) END AS di, CASE WHEN length(li) = 0 THEN 0.0 ELSE length(regexp_replace(li, '[^\p{{L}}]', '', 'g')) / length(li) END AS le,
  len(list_filter(string_split_regex(li, '\s+'), lambda w: regexp_matches(w, '\p{{Nd}}'))) AS nu, len(list_filter(string_split_regex(li, '\s+'), lambda w: w <> '')) AS wo FROM (SELECT *, trim(line) AS li FROM lines)), blocks AS (SELECT doc_id, i, line, {TYPE_SQL} AS block_type FROM m)"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, text) of the lines of documents."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "text")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; texts have no fonts, so a line without punctuation at its end stands for a bold one.

    The type is exploded from an array of one, since a filter on it would otherwise be pushed below it and work it out twice.
    """
    kind = P.block_type(F.col("text"), bold=~F.trim("text").rlike(r"[.;:,|]\s*$"))
    return lines_of(spark, sf_dir).select("doc_id", "i", "text", F.explode(F.array(kind)).alias("block_type"))


@query("block_types", f"WITH {BLOCKS_SQL} SELECT block_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(length(line))::BIGINT AS chars FROM blocks GROUP BY 1")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).groupBy("block_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("chars"))


@query(
    "nearest_heading",
    f"""WITH {BLOCKS_SQL}, h AS (SELECT doc_id, i, block_type, last_value(CASE WHEN block_type = 'HEADING' THEN line END IGNORE NULLS) OVER w AS heading, (sum((block_type = 'HEADING')::INT) OVER w)::BIGINT AS run FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc_id, i, heading, run FROM h WHERE block_type <> 'HEADING'""",
)
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.heading_runs(blocks_of(spark, sf_dir), ["doc_id"], "i", F.col("block_type") == "HEADING")
    b = b.withColumn("heading", W.last_known(F.when(F.col("block_type") == "HEADING", F.col("text")), ["doc_id"], ["i"]))
    return b.where("block_type <> 'HEADING'").select("doc_id", "i", "heading", "run")


@query(
    "table_adjacent",
    f"""WITH {LINES_SQL}, b AS (SELECT doc_id, i, contains(line, '|') AS tb FROM lines), x AS (SELECT doc_id, i, tb, coalesce(lag(tb) OVER w, false) AS before, coalesce(lead(tb) OVER w, false) AS after FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, i FROM x WHERE NOT tb AND (before OR after)""",
)
def table_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines_of(spark, sf_dir).withColumn("tb", F.contains("text", F.lit("|")))
    return W.beside_tables(b, ["doc_id"], "i", F.col("tb"), F.lit(True)).where("near_table").select("doc_id", "i")


@query(
    "neighbour_chunks",
    f"""WITH {LINES_SQL}, n AS (SELECT doc_id, i, lag(line) OVER w AS b, line, lead(line) OVER w AS a FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, i, s.k AS strategy, s.c AS chunk FROM (SELECT doc_id, i, unnest([struct_pack(k := 'previous_current', c := b || chr(10) || chr(10) || line), struct_pack(k := 'current_next', c := line || chr(10) || chr(10) || a), struct_pack(k := 'local_window', c := b || chr(10) || chr(10) || line || chr(10) || chr(10) || a)]) AS s FROM n) WHERE s.c IS NOT NULL""",
)
def neighbour_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.neighbour_chunks(lines_of(spark, sf_dir), "doc_id", "i", "text")


@query("segmentation")
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy passages of each document's blocks; sequential, tested on literals."""
    return P.segmented(blocks_of(spark, sf_dir), "doc_id", "i")


@query("qa_chunks")
def qa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over the blocks of every document as passages; token counts are injected, here one a word and six characters."""
    b = blocks_of(spark, sf_dir).where("block_type in ('PARAGRAPH', 'HEADING', 'LIST_ITEM')")
    heading = F.when(F.col("block_type") == "HEADING", F.col("text"))
    page = F.ceil(F.col("i") / 20).cast("int")
    p = b.select("doc_id", "i", F.col("i").alias("id"), "text", heading.alias("heading"), page.alias("page_start"), page.alias("page_end"))

    def word(w: str) -> int:
        return 1 + len(w) // 6

    return P.chunked(p, "doc_id", "i", word, lambda text: 2 + sum(map(word, text.split())))


@query("text_diff")
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pair_queries import S as similarity

    pairs = similarity.consecutive(t(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", ["text"])
    return P.diffed(pairs, "earlier_doc_id", "earlier_text", "later_text")


@query(
    "ordered_narrative",
    f"""WITH {BLOCKS_SQL} SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY i) AS narrative, sha256(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS content_hash FROM blocks WHERE block_type IN ('PARAGRAPH', 'HEADING', 'LIST_ITEM') GROUP BY doc_id""",
)
def ordered_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.aggregates import narrative

    b = blocks_of(spark, sf_dir).where(F.col("block_type").isin("PARAGRAPH", "HEADING", "LIST_ITEM"))
    return narrative(b, ["doc_id"], ["i"], "text").withColumn("content_hash", T.content_hash(F.col("narrative")))


@query(
    "quality_tiers",
    r"""WITH q AS (SELECT source, CASE WHEN length(trim(text)) = 0 THEN 'FAILED' WHEN length(text) < 40 THEN 'NEEDS_REVIEW' WHEN length(text) >= 120 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) >= 0.5 THEN 'GOOD' ELSE 'USABLE' END AS quality, quality AS label FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, quality, count(*) AS n, count(label) AS labelled, round(avg(label), 6) AS mean_label FROM q GROUP BY 1, 2""",
)
def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    tier = F.when(F.length(F.trim(x)) == 0, F.lit("FAILED")).when(F.length(x) < 40, F.lit("NEEDS_REVIEW")).when((F.length(x) >= 120) & (T.share_of(x, "L") >= 0.5), F.lit("GOOD")).otherwise(F.lit("USABLE"))
    d = t(spark, sf_dir, "documents").select("doc_id", "source", tier.alias("quality")).join(t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return d.groupBy("source", "quality").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.round(F.avg("label"), 6).alias("mean_label"))


@query(
    "stricter_quality",
    """SELECT doc_id, CASE WHEN a = 'NEEDS_REVIEW' OR b = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' WHEN a = 'USABLE' OR b = 'USABLE' THEN 'USABLE' ELSE 'GOOD' END AS quality FROM (
      SELECT doc_id, CASE quality WHEN 1 THEN 'GOOD' ELSE 'USABLE' END AS a, CASE toxic WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS b FROM labels)""",
)
def stricter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("quality") == 1, F.lit("GOOD")).otherwise(F.lit("USABLE")), F.when(F.col("toxic") == 1, F.lit("NEEDS_REVIEW")).otherwise(F.lit("GOOD"))
    return t(spark, sf_dir, "labels").select("doc_id", C.stricter(a, b).alias("quality"))


@query(
    "page_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>', 0)) AS a FROM pages)
    SELECT page_id, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS url, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM a""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("a"))
    return a.select("page_id", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("text"))


@query(
    "best_page_by_host",
    r"""SELECT lower(regexp_extract(url, '//([^/:?#]*)', 1)) AS host, page_id, length(html)::BIGINT AS n FROM pages QUALIFY row_number() OVER (PARTITION BY lower(regexp_extract(url, '//([^/:?#]*)', 1)) ORDER BY length(html) DESC, page_id) = 1""",
)
def best_page_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "//([^/:?#]*)", 1)).alias("host"), "page_id", F.length("html").cast("long").alias("n"))
    return files.best_by(p, ["host"], F.desc("n"), F.col("page_id"))


@query(
    "keyword_search",
    rf"""WITH tk AS (SELECT doc_id, {TOKENS_SQL} AS tk FROM documents), h AS (SELECT doc_id, len(list_filter(tk, lambda x: x = 'with')) AS a, len(list_filter(tk, lambda x: x = 'from')) AS b, len(list_filter(tk, lambda x: x = 'no')) AS c, len(tk) AS n FROM tk)
    SELECT doc_id, round((ln(1 + a) + ln(1 + b)) / ln(2 + n), 6) AS score, row_number() OVER (ORDER BY round((ln(1 + a) + ln(1 + b)) / ln(2 + n), 6) DESC, doc_id) AS rank FROM h WHERE a > 0 AND b > 0 AND c = 0 QUALIFY rank <= 100""",
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_search(t(spark, sf_dir, "documents"), "doc_id", "text", S.parsed("with from -no"), 100)


@query(
    "term_coverage",
    rf"""WITH q AS (SELECT item_id, list_sort(list_distinct(list_filter({TOKENS_SQL}, lambda w: length(w) >= 8))) AS terms FROM benchmark), tk AS (SELECT doc_id, list_distinct({TOKENS_SQL}) AS tk FROM documents),
    e AS (SELECT item_id, unnest(terms) AS term, len(terms) AS n FROM q), d AS (SELECT doc_id, unnest(tk) AS term FROM tk)
    SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS coverage FROM e JOIN d USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) <= 5""",
)
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of each item's long terms, by an equi-join on terms."""
    q = t(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 8)).alias("terms"))
    return S.covering(q, "item_id", "terms", t(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("tk")), "doc_id", "tk", 5).select("item_id", "doc_id", F.round("coverage", 6).alias("coverage"))


@query(
    "turn_neighbours",
    """SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after, length(text)::BIGINT AS n, (turn = max(turn) OVER (PARTITION BY conv_id)) AS is_last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def turn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    o = w.orderBy("turn")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(o).alias("before"), F.lead("role").over(o).alias("after"), F.length("text").cast("long").alias("n"), (F.col("turn") == F.max("turn").over(w)).alias("is_last"))
