"""What the pages of a site ask for: parameters, optional filters, display and publication rules, and their projections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that parameters may take, their lengths, page sizes.
STATUSES = ("UNCHANGED", "LIGHTLY_MODIFIED", "SUBSTANTIALLY_MODIFIED", "NEW", "REMOVED", "AMBIGUOUS")
MATCHED = STATUSES[:3]
CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "NEEDS_REVIEW")
QUALITIES = ("GOOD", "USABLE", "NEEDS_REVIEW", "FAILED")
SORTS = ("relevance", "newest_report", "oldest_report", "company", "confidence")
LONGEST_QUERY, LONGEST_TOKEN, PAGE_SIZE, MOST_ON_PAGE = 200, 64, 25, 50


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


@dataclass(frozen=True)
class Parameters:
    """What a search asks for; None is no predicate."""

    query: str | None = None
    phrase: bool = False
    company: str | None = None
    since: str | None = None
    until: str | None = None
    status: str | None = None
    confidence: str | None = None
    category: str | None = None
    subcategory: str | None = None
    quality: str | None = None
    eligible: bool | None = None
    sort: str = "newest_report"
    page: int = 1
    page_size: int = PAGE_SIZE


def parameters(raw: Mapping[str, str | Sequence[str] | None]) -> Parameters:
    """Untrusted strings as parameters: of several values the first counts, and what isn't valid is no predicate."""

    def text(key: str, longest: int) -> str | None:
        value = raw.get(key)
        value = value if isinstance(value, str) or value is None else (value[0] if value else None)
        return ((value or "").strip()[:longest]) or None

    def one_of(key: str, names: Sequence[str]) -> str | None:
        value = text(key, LONGEST_QUERY)
        return value if value in names else None

    def date(key: str) -> str | None:
        value = text(key, LONGEST_QUERY)
        return value if value and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else None

    def flag(key: str) -> bool | None:
        return {"1": True, "true": True, "0": False, "false": False}.get(text(key, LONGEST_QUERY) or "")

    def count(key: str, fallback: int) -> int:
        m = re.match(r"[+-]?\d+", text(key, LONGEST_QUERY) or "")
        return int(m[0]) if m and int(m[0]) >= 1 else fallback

    query, category, company = text("q", LONGEST_QUERY), text("category", LONGEST_TOKEN), text("company", LONGEST_TOKEN)
    sort = one_of("sort", SORTS) or "relevance"
    return Parameters(
        query, bool(flag("phrase")), company.upper() if company else None, date("periodStart"), date("periodEnd"), one_of("status", STATUSES), one_of("confidence", CONFIDENCES),
        category, text("subcategory", LONGEST_TOKEN) if category else None, one_of("quality", QUALITIES), flag("feature"), "newest_report" if sort == "relevance" and query is None else sort,
        count("page", 1), min(count("pageSize", PAGE_SIZE), MOST_ON_PAGE),
    )


def evidence(
    rows: DataFrame, signals: DataFrame, status: str | None = None, confidence: str | None = None, collision: bool | None = None, split: bool | None = None, heading: bool | None = None,
    first_page: int | None = None, last_page: int | None = None, category: str | None = None, subcategory: str | None = None,
) -> DataFrame:
    """rows (comparison_id, two sides) under optional filters; a heading of either side counts, pages are the earlier side's if it is there.

    signals: (comparison_id, category, subcategory, raw_count); a category must have a count, which is a semi join.
    """
    either = F.col("earlier_heading").isNotNull() | F.col("later_heading").isNotNull()
    wanted = all_of(
        None if status in (None, "ALL") else F.col("status") == status,
        None if confidence is None else F.col("confidence") == confidence,
        None if collision is None else F.col("collision") == collision,
        None if split is None else F.col("split") == split,
        None if heading is None else either if heading else ~either,
        None if first_page is None else F.coalesce("earlier_first_page", "later_first_page") >= first_page,
        None if last_page is None else F.coalesce("earlier_last_page", "later_last_page") <= last_page,
    )
    out = rows.where(wanted)
    if category is None:
        return out
    found = signals.where(all_of(F.col("category") == category, F.col("raw_count") > 0, None if subcategory is None else F.col("subcategory") == subcategory))
    return out.join(found.select("comparison_id"), "comparison_id", "left_semi")


def needs_review(status: Column, quality: Column, eligible: Column) -> Column:
    """Never run, failed or warned, of poor quality, or not eligible."""
    return status.isNull() | F.coalesce(status.isin("FAILED", "COMPLETED_WITH_WARNINGS"), F.lit(False)) | F.coalesce(quality.isin("NEEDS_REVIEW", "FAILED"), F.lit(False)) | F.coalesce(~eligible, F.lit(False))


def displayed(quality: Column, score: Column) -> Column:
    """The score, but null where the quality is FAILED; eligibility doesn't matter, an unknown quality isn't a failed one."""
    return F.when(F.coalesce(quality != "FAILED", F.lit(True)), score)


def publishable(status: Column, earlier: Column, later: Column) -> Column:
    """Whether a row may be published by the sides of it that are: one at least, both of a match, the side that NEW or REMOVED names."""
    e, w = earlier.isNotNull(), later.isNotNull()
    return F.when(status.isin(*MATCHED), e & w).when(status == "NEW", w).when(status == "REMOVED", e).otherwise(e | w)


def published_rows(rows: DataFrame, passages: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """rows whose sides are among the published passages (key) as their status asks; a side that isn't becomes null."""
    out = rows
    for side in (earlier, later):
        known = passages.select(F.col(key).alias(f"_{side}"))
        out = out.join(known, F.col(side) == F.col(f"_{side}"), "left").withColumn(side, F.col(f"_{side}")).drop(f"_{side}")
    return out.where(publishable(F.col("status"), F.col(earlier), F.col(later)))


def comparison_columns(pair: str, sides: Mapping[str, Sequence[str]], metrics: Sequence[str]) -> list[Column]:
    """The columns that every query of comparisons shows, in their order: the pair, both sides' and the metrics."""
    return [F.col(pair), *[F.col(f"{side}_{c}") for side, names in sides.items() for c in names], *[F.col(m) for m in metrics]]


def both_sides(rows: DataFrame, passages: DataFrame, key: str, columns: Sequence[str], sides: tuple[str, str] = ("earlier", "later")) -> DataFrame:
    """rows with the passage columns of both sides, prefixed; a missing side has nulls."""
    out = rows
    for side in sides:
        side_of = passages.select(F.col(key).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(side_of, f"{side}_id", "left")
    return out


def block_types_of(bridge: DataFrame, blocks: DataFrame, passage: str, block: str, order: str, kind: str) -> DataFrame:
    """(passage, types): the types of a passage's blocks in their order, through the bridge (passage, block, order)."""
    joined = bridge.join(blocks.select(block, kind), block)
    return joined.groupBy(passage).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias("types"))


def of_same_lineage(features: DataFrame, language: DataFrame, pair: str, run: str, payload: Sequence[str]) -> DataFrame:
    """features with the payload of the language result that used the same run; mismatch tells of one that used another."""
    own = language.select(pair, F.col(run).alias("_run"), *payload)
    joined = features.join(own, pair, "left")
    same = F.coalesce(F.col("_run") == F.col(run), F.lit(False))
    return joined.select(*features.columns, *[F.when(same, F.col(c)).alias(c) for c in payload], (F.col("_run").isNotNull() & ~same).alias("mismatch"))


def near_another(candidates: DataFrame, report: str, page: str, within: int = 1) -> DataFrame:
    """candidates with `near`: whether another one of the report lies within so many pages. One range window, no self-join."""
    around = Window.partitionBy(report).orderBy(page).rangeBetween(-within, within)
    return candidates.withColumn("near", F.coalesce(F.count(page).over(around) > 1, F.lit(False)))


def by_page(rows: DataFrame, page: Column, key: str) -> list[Column]:
    """The order by page, unknown pages last, ties by key."""
    return [page.asc_nulls_last(), F.col(key).asc()]


def facet_order(value: Column, known: Sequence[str]) -> list[Column]:
    """Known values in their order, then the others by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in known]), value), F.lit(0))
    return [F.when(place > 0, place).otherwise(F.lit(len(known) + 1)).asc(), value.asc()]


def merged_strategies(chunks: DataFrame, strategy: str, text: str, member: str) -> DataFrame:
    """(strategy, text_hash, members, n): chunks of one strategy with equal texts as one, with the members of all."""
    found = chunks.groupBy(strategy, F.sha2(F.col(text), 256).alias("text_hash"))
    return found.agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("n"))


def title_year(period_end: Column, fiscal_label: Column, directory_year: Column) -> Column:
    """The first of a report's dates that is known, as text."""
    return F.coalesce(F.date_format(period_end, "yyyy-MM-dd"), fiscal_label.cast("string"), directory_year.cast("string"))


def counters(rows: DataFrame, key: str, counts: str, known: Sequence[str]) -> DataFrame:
    """(key, totals map): the sums of maps of counts by name; known names are there with 0, unknown ones with their sum."""
    long = rows.select(key, F.explode(counts).alias("name", "n"))
    sums = long.groupBy(key, "name").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("sums"))
    zero = F.create_map(*[x for k in known for x in (F.lit(k), F.lit(0).cast("long"))])
    every = rows.select(key).distinct().join(sums, key, "left").withColumn("sums", F.coalesce("sums", zero))
    return every.select(key, F.map_zip_with(zero, "sums", lambda k, a, b: F.coalesce(b, a)).alias("totals"))


def passage_type(heading: Column, types: Column, near_table: Column) -> Column:
    """By heading, then all of its blocks being list items, then their number; beside a table the last two are its context."""
    plain = F.when(near_table, F.lit("TABLE_CONTEXT")).when(F.size(types) > 1, F.lit("MULTI_PARAGRAPH")).otherwise(F.lit("PARAGRAPH"))
    return F.when(heading.isNotNull(), F.lit("HEADING_WITH_BODY")).when(F.forall(types, lambda x: x == "LIST_ITEM"), F.lit("LIST")).otherwise(plain)


def metadata_status(pages: Column, period_end: Column) -> Column:
    """Without pages a report is rejected; with a period it is valid; else it waits for review."""
    return F.when(F.coalesce(pages, F.lit(0)) == 0, F.lit("REJECTED")).when(period_end.isNotNull(), F.lit("VALIDATED")).otherwise(F.lit("NEEDS_REVIEW"))

