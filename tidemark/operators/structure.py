"""Rules over pages, blocks and passages: recurring headers, structured content, fiscal evidence, provenance, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T

#: Bands of a page that headers and footers stand in, share of pages they recur on, pages a document needs (fixed values).
TOP, BOTTOM, RECURS, PAGES = 0.12, 0.10, 0.60, 5


def recurring_edges(blocks: DataFrame, doc: str, page: str, position: str, height: str, text: str) -> DataFrame:
    """blocks with is_header and is_footer: in the band, and of a normal form that recurs on enough distinct pages.

    position: distance of the block from the top. The number of pages is rounded half to even.
    """
    band = F.when(F.col(position) <= TOP * F.col(height), F.lit("header")).when(F.col(position) >= (1 - BOTTOM) * F.col(height), F.lit("footer"))
    marked = blocks.withColumn("_band", band).withColumn("_norm", T.header_form(F.col(text)))
    pages = blocks.groupBy(doc).agg(F.countDistinct(page).alias("_pages"))
    often = marked.where("_band is not null and _norm <> ''").groupBy(doc, "_band", "_norm").agg(F.countDistinct(page).alias("_on"))
    often = often.join(pages, doc).where((F.col("_pages") >= PAGES) & (F.col("_on") >= F.greatest(F.lit(2), F.bround(F.col("_pages") * RECURS).cast("int")))).select(doc, "_band", "_norm", F.lit(True).alias("_hit"))
    out = marked.join(often, [doc, "_band", "_norm"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumn("is_header", hit & (F.col("_band") == "header")).withColumn("is_footer", hit & (F.col("_band") == "footer")).select(*blocks.columns, F.coalesce("is_header", F.lit(False)).alias("is_header"), F.coalesce("is_footer", F.lit(False)).alias("is_footer"))


def page_quality(text: Column, images: Column) -> Column:
    """Empty pages fail; images alone or little text need review; enough text that is mostly letters is good."""
    n = F.length(F.trim(text))
    return (
        F.when((F.coalesce(n, F.lit(0)) == 0) & (F.coalesce(images, F.lit(0)) == 0), F.lit("FAILED")).when((F.coalesce(n, F.lit(0)) < 40), F.lit("NEEDS_REVIEW"))
        .when((n >= 120) & (T.share_of(text, "L") >= 0.5), F.lit("GOOD")).otherwise(F.lit("USABLE"))
    )


def report_quality(pages: DataFrame, doc: str, quality: str) -> DataFrame:
    """Share of usable pages of each document and its tier."""
    agg = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(F.col(quality).isin("GOOD", "USABLE")).alias("usable"), F.count_if(F.col(quality) == "FAILED").alias("empty"))
    share, empty = F.col("usable") / F.col("pages"), F.col("empty") / F.col("pages")
    tier = F.when(share < 0.40, F.lit("FAILED")).when((share < 0.80) | (empty > 0.05), F.lit("NEEDS_REVIEW")).when(share < 0.95, F.lit("USABLE")).otherwise(F.lit("GOOD"))
    return agg.withColumn("usable_share", share).withColumn("quality", tier)


#: Patterns of structured content (fixed values).
INDEX = r"(?i)\bGRI\b|\bSASB\b|\bTCFD\b|\bESG\s+index\b|sustainability\s+index|integrated\s+report(?:ing)?\s+index|\bIIRC\b"
LEADERS = r"\.{3,}\s*[0-9]{1,4}\b"
CONTENTS = r"(?i)^\s*(contents|table of contents|index)\s*$"
CAPTION = r"(?i)^\s*(figure|table|chart|graph|source)\s*[:\-0-9]"
YEAR_PAIRS = r"\(\s*(?:19|20)[0-9]{2}\s*:\s*[0-9,.]+\s*%?\s*\)"
GRANTS = r"(?i)\bgrant date\b|\bvesting date\b|\brights series\b|\bexercise price\b"
SERIES = r"(?i)\bseries\s+[a-z0-9]+\b"
DATES = r"\b[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}\b|\b[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}\b"
HOLDERS = r"(?i)largest holders|shareholders and cdi holders|top\s+[0-9]+\s+shareholders"
MEETINGS = r"(?i)number of meetings\b"
DIGIT_PAIRS = r"\b[0-9]\s+[0-9]\b"
CURRENCIES = r"\b(?:USD|GBP|EUR|ZAR|AUD|CAD|CHF|JPY|CNY|XAF|XOF|NAD|BWP|ZMW|MZN|NGN|KES|GHS|MUR|NOK|SEK|DKK|INR|HKD)\b"
#: Digit share that is elevated and one that is too much, share of fragments that is too much and one that is little, words
#: of coherent prose (fixed values).
DIGITS, DIGITS_MOST, FRAGMENTS, FRAGMENTS_FEW, PROSE = 0.15, 0.20, 0.5, 0.3, 40


def _hits(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rendered_table(text: Column, heading: Column) -> Column:
    """What kind of table a text is that reads like prose, by the first evidence that holds; null without any."""
    grants = text.rlike(GRANTS) & ((_hits(text, SERIES) >= 2) | (_hits(text, DATES) >= 2) | T.repeats_phrase(text))
    financial = T.grouped_numbers(text) | (_hits(text, YEAR_PAIRS) >= 2) | grants
    financial = financial | F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text).rlike(HOLDERS)
    financial = financial | (text.rlike(MEETINGS) & (_hits(text, DIGIT_PAIRS) >= 3))
    return F.when(financial, F.lit("financial_table_rendered_as_prose")).when(_hits(text, CURRENCIES) >= 4, F.lit("currency_exposure_table_mixed"))


def _two_characters(heading: Column, passage_type: Column) -> Column:
    return (F.length(_stripped(F.coalesce(heading, F.lit("")))) == 2) & F.coalesce(passage_type == "HEADING_WITH_BODY", F.lit(False))


def structured_category(text: Column, heading: Column, passage_type: Column, list_item: Column) -> Column:
    """What kind of structured content a passage is, by the first rule that fits; null for ordinary narrative or no text.

    list_item: whether a block of the passage is an item of a list.
    """
    words, digits, own = T.word_count(text), T.share_of(text, "Nd"), _stripped(text)
    h = _stripped(F.coalesce(heading, F.lit("")))
    body = F.when(own.startswith(h), F.substr(own, F.length(h) + 1)).otherwise(text)
    two, shattered = _two_characters(heading, passage_type), T.fragment_share(own)
    prose = (words >= PROSE) & text.rlike("[.!?]") & (shattered < FRAGMENTS_FEW)
    numeric, beside = (words >= 5) & (digits >= DIGITS), F.coalesce(passage_type == "TABLE_CONTEXT", F.lit(False))
    mistaken = F.coalesce(rendered_table(text, heading), F.lit("ordinary_prose_false_positive"))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(two & (words == 1), F.lit("short_fragment_invalid"))
        .when(two & (T.fragment_share(body) > FRAGMENTS), F.lit("broken_fragment_sequence"))
        .when(two & body.rlike("[.!?]"), F.lit("legitimate_short_abbreviation"))
        .when(two, F.lit("caption_or_label_like"))
        .when((words >= 10) & (shattered > FRAGMENTS), F.lit("broken_fragment_sequence"))
        .when(text.rlike(INDEX) | text.rlike(LEADERS) | own.rlike(CONTENTS), F.lit("contents_or_index_like"))
        .when(own.rlike(CAPTION), F.lit("caption_or_label_like"))
        .when(numeric & prose & (digits < DIGITS_MOST), mistaken)
        .when(numeric, F.lit("numeric_or_table_like_source"))
        .when(beside & prose, mistaken)
        .when(beside, F.lit("table_context"))
        .when(F.coalesce((passage_type == "LIST") | list_item, F.lit(False)), F.lit("list_content"))
    )


def structured_action(category: Column, heading: Column, passage_type: Column) -> Column:
    """What is suggested for a passage of a category: EXCLUDE, REVIEW or RETAIN; null where nothing is."""
    two, h = _two_characters(heading, passage_type), _stripped(heading)
    return (
        F.when(category == "short_fragment_invalid", F.when(h.rlike(r"^\p{Lu}+$"), F.lit("REVIEW")).otherwise(F.lit("EXCLUDE")))
        .when(category == "caption_or_label_like", F.when(two, F.lit("REVIEW")).otherwise(F.lit("EXCLUDE")))
        .when(category.isin("broken_fragment_sequence", "contents_or_index_like", "numeric_or_table_like_source", "financial_table_rendered_as_prose"), F.lit("EXCLUDE"))
        .when(category == "currency_exposure_table_mixed", F.lit("REVIEW"))
        .when(category.isin("legitimate_short_abbreviation", "ordinary_prose_false_positive"), F.lit("RETAIN"))
    )


def fiscal_evidence(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, proposed, confidence, months, transition): dates of `ended D Month YYYY` phrases over a document's first pages.

    One distinct date is HIGH, several MEDIUM with the first proposed, none NONE.
    """
    phrases = F.regexp_extract_all(F.col(text), F.lit(r"(?i)(?:year|period)\s+ended\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})"), F.lit(1))
    found = pages.select(doc, page, F.posexplode_outer(phrases).alias("at", "phrase"), F.nullif(F.regexp_extract(F.lower(F.col(text)), r"(\d{1,2})\s+months\s+ended", 1), F.lit("")).alias("m"), F.lower(F.col(text)).rlike(r"transition(?:al)? (?:report|period)").alias("t"))
    date = N.phrase_date(F.initcap(F.regexp_replace("phrase", r"\s+", " ")))
    agg = found.withColumn("d", date).groupBy(doc).agg(
        F.min_by("d", F.when(F.col("d").isNotNull(), F.struct(page, "at"))).alias("proposed"), F.countDistinct("d").alias("n"), F.min(F.col("m").cast("int")).alias("months"), F.coalesce(F.bool_or("t"), F.lit(False)).alias("transition")
    )
    return agg.select(doc, "proposed", F.when(F.col("n") == 0, F.lit("NONE")).when(F.col("n") == 1, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("confidence"), "months", "transition")


def inversions(sources: DataFrame, blocks: DataFrame, doc: str, passage: str, place: str, block: str, order: list[str]) -> DataFrame:
    """(doc, inverted): passages whose blocks, by their place in the passage, don't follow the source's order.

    order: columns of blocks, such as page and reading order. Blocks that the source lacks don't count.
    """
    at = F.struct(*[F.col(c) for c in order])
    placed = sources.join(blocks.select(doc, block, at.alias("_at")), [doc, block])
    before = F.lag("_at").over(Window.partitionBy(doc, passage).orderBy(place, block))
    wrong = placed.withColumn("_wrong", F.coalesce(before > F.col("_at"), F.lit(False))).groupBy(doc, passage).agg(F.max("_wrong").alias("_wrong"))
    return wrong.groupBy(doc).agg(F.count_if("_wrong").alias("inverted"))


def provenance(blocks: DataFrame, sources: DataFrame, doc: str, block: str, words: str, passage_words: DataFrame, inverted: DataFrame | None = None) -> DataFrame:
    """(doc, omitted, duplicated, drift, verdict): blocks that no passage or more than one holds, and how far words differ.

    Given `inverted` (doc, inverted), it is a column too, and passages out of order are a warning.
    """
    used = sources.groupBy(doc, block).agg(F.count("*").alias("uses"))
    agg = blocks.join(used, [doc, block], "left").groupBy(doc).agg(F.count_if(F.col("uses").isNull()).alias("omitted"), F.count_if(F.col("uses") > 1).alias("duplicated"), F.sum(words).alias("block_words"))
    out = agg.join(passage_words, doc, "left").withColumn("drift", N.ratio(F.abs(F.col("block_words") - F.coalesce("passage_words", F.lit(0))).cast("double"), F.col("block_words")))
    verdict = F.when((F.col("omitted") > 0) | (F.col("duplicated") > 0), F.lit("FAILED")).when((F.col("drift") > 0.02) | (F.col("inverted") > 0), F.lit("WARNING")).otherwise(F.lit("PASSED"))
    out = out.withColumn("inverted", F.lit(0).cast("long")) if inverted is None else out.join(inverted, doc, "left").fillna(0, ["inverted"])
    return out.select(doc, "omitted", "duplicated", "drift", *([] if inverted is None else ["inverted"]), verdict.alias("verdict"))


def highlighted(text: Column, terms: list[str]) -> Column:
    """text as spans (text, matched): whole words of terms in any case, everything between them as it is."""
    pattern = r"(?iu)\b(?:" + "|".join(sorted(map(_quoted, terms), key=len, reverse=True)) + r")\b"
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    spans = F.flatten(F.transform(pairs, lambda x: F.array(F.struct(x["gap"].alias("text"), F.lit(False).alias("matched")), F.struct(x["hit"].alias("text"), F.lit(True).alias("matched")))))
    return F.filter(spans, lambda s: s["text"].isNotNull() & (s["text"] != ""))


def _quoted(term: str) -> str:
    import re

    return re.escape(term)


def side_quality(coverage: Column, match_rate: Column, gap: Column) -> tuple[Column, Column]:
    """Quality of one side's language signals, and why."""
    why = T.reasons(F.when(coverage < 0.70, F.lit("low word coverage")), F.when(match_rate < 0.02, F.lit("very low match rate")), F.when((match_rate >= 0.02) & (match_rate < 0.05), F.lit("low match rate")), F.when(N.irregular(gap), F.lit("irregular gap")))
    status = F.when(coverage.isNull(), F.lit("FAILED")).when((coverage < 0.70) | (match_rate < 0.02), F.lit("NEEDS_REVIEW")).when(why.isNotNull(), F.lit("USABLE")).otherwise(F.lit("GOOD"))
    return status, why


def change_quality(ambiguous: Column, collisions: Column, unmatched: Column, upstream: Column) -> tuple[Column, Column]:
    """Quality of change signals, and why; a failed upstream fails it."""
    why = T.reasons(F.when(ambiguous > 0.15, F.lit("ambiguous share")), F.when(collisions > 0.60, F.lit("collision share")), F.when(unmatched > 0.40, F.lit("unmatched share")), F.when(upstream == "NEEDS_REVIEW", F.lit("upstream quality")))
    status = F.when(upstream == "FAILED", F.lit("FAILED")).when((collisions > 0.85) | (upstream == "NEEDS_REVIEW") | (ambiguous > 0.15), F.lit("NEEDS_REVIEW")).when(why.isNotNull(), F.lit("USABLE")).otherwise(F.lit("GOOD"))
    return status, why


def fitted(parts: dict[str, str], count, most: int) -> dict[str, str]:
    """Drop heading, next and previous in this order until the parts fit; then trim the sides by sentence, last by word."""
    import re

    kept = dict(parts)
    total = lambda: sum(count(v) for v in kept.values())
    for name in ("heading", "next", "previous"):
        if total() > most:
            kept.pop(name, None)
    for name in list(kept):
        pieces = re.split(r"(?<=[.!?])\s+", kept[name])
        while total() > most and len(pieces) > 1:
            pieces.pop()
            kept[name] = " ".join(pieces)
        words = kept[name].split()
        while total() > most and len(words) > 1:
            words.pop()
            kept[name] = " ".join(words)
    return kept
