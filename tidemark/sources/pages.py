"""Pages as documents with blocks: what a page reader gives, from markup in place of a layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = r"(?i)</?(?:h[1-6]|p|div|ul|ol|li|section|blockquote|article|nav|footer|header|aside|table|tr|td|title|body|head|html)(?:\s[^>]*)?>"
SILENT = r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"


def plain(text: Column) -> Column:
    """Without inline tags, with the five basic character references decoded, single blanks, trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", " "), r"(?s)<[^>]*>", "")
    for ref, c in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_index, text) of the blocks in page order, from 0, empty ones left out; null html has none."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(html, SILENT, ""), BLOCKS), plain), lambda x: x != "")
    return pages.select(key, F.posexplode(parts).alias("block_index", "text"))


def status(pages: DataFrame, html: str) -> DataFrame:
    """pages with read_status in place of an exception: MISSING, EMPTY, UNREADABLE (no markup) or READ."""
    x = F.col(html)
    return pages.withColumn("read_status", F.when(x.isNull(), F.lit("MISSING")).when(F.length(F.trim(x)) == 0, F.lit("EMPTY")).when(~F.contains(x, F.lit("<")), F.lit("UNREADABLE")).otherwise(F.lit("READ")))
