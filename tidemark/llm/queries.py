"""The thin queries of the corpus operators: each reads its table, applies its operator and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark
), grams AS (
  SELECT kind, id, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM low WHERE len(w) >= 5
), items AS (
  SELECT id AS item_id, n, s, count(*) AS c FROM grams WHERE kind = 'i' GROUP BY ALL
), hits AS (
  SELECT g.id AS doc_id, g.n AS doc_n, i.item_id, i.n AS item_n, g.pos, g.s, i.c FROM grams g JOIN items i ON g.s = i.s WHERE g.kind = 'd'
), starts AS (
  SELECT DISTINCT doc_id, item_id, least(doc_n, item_n) AS n_words, item_n, unnest(range(greatest(0, pos - least(doc_n, item_n) + 5), least(pos, doc_n - least(doc_n, item_n)) + 1)) AS first_word FROM hits
), shared AS (
  SELECT t.doc_id, t.item_id, t.n_words, t.item_n, t.first_word, h.s, least(count(*), any_value(h.c)) AS inboth
  FROM starts t JOIN hits h ON h.doc_id = t.doc_id AND h.item_id = t.item_id AND h.pos BETWEEN t.first_word AND t.first_word + t.n_words - 5 GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, n_words, first_word, sum(inboth) / (n_words - 4 + item_n - 4 - sum(inboth)) AS similarity FROM shared GROUP BY doc_id, item_id, n_words, item_n, first_word
)
SELECT doc_id, item_id, first_word::INTEGER AS first_word, n_words::INTEGER AS n_words, similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * p.both >= 85 * (m.n + n.n - p.both)
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(r.c, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, RULES, named, scanned

    def at(i: int):
        return lambda s: s["place"] == i

    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    counts = [F.size(F.filter("spans", at(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return scanned(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(named(base, RULES), 256).alias("base_sha256"), named(F.col("spans"), RULES).alias("spans"))


def _op4_sql() -> str:
    from .secrets import BASE, RULES

    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, '{r.kind}' AS kind, {i} AS place, s, s + length(hits[k]) AS e FROM (
    SELECT doc_id, k, hits, parts, (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0))::BIGINT AS s
    FROM (SELECT doc_id, hits, gaps, parts, unnest(range(1, len(hits) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS hits, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {r.group}) AS parts FROM d
    ))
  ) WHERE length(parts[k]) >= {max(r.least, 1)}""")
    counts = ", ".join(f"count(*) FILTER (place = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(parts)}
), digests AS (SELECT doc_id, {counts}, {joined} FILTER (place < {len(BASE)}) AS base, {joined} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN digests USING (doc_id)"""


OP4_SQL = _op4_sql()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer_path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identified

    return identified(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || h[1 + (i // 4) * 5:5 + (i // 4) * 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM p JOIN o USING (h)
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:h[1-6]|p|div|ul|ol|li|section|blockquote)(?: [^>]*)?>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express, by query name."""
    found = {}
    for name in queries():
        number = name.split("_")[0]
        if sql := globals().get(f"{number.upper()}_SQL"):
            found[name] = sql
    return found
