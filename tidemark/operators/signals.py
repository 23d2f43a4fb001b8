"""Language signals of aligned passages: sides as rows, populations as filters, variants as copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N

#: Shown names of qualities, of those of attribution, and of confidences (fixed values).
QUALITY_LABELS = {"GOOD": "Analysis ready", "USABLE": "Ready with caution", "NEEDS_REVIEW": "Review recommended", "FAILED": "Unavailable"}
ATTRIBUTION_LABELS = {"GOOD": "Strong attribution", "USABLE": "Usable attribution", "NEEDS_REVIEW": "Attribution uncertain", "FAILED": "Attribution unavailable"}
CONFIDENCE_LABELS = {"HIGH": "High confidence", "MEDIUM": "Medium confidence", "LOW": "Low confidence", "NEEDS_REVIEW": "Needs review"}


def label(value: Column, labels: dict[str, str] = QUALITY_LABELS) -> Column:
    """Shown name of a quality or confidence; null for an unknown one."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def side_rows(alignments: DataFrame, earlier: str, later: str, name: str) -> DataFrame:
    """One row for each side that an alignment has: report_side and name."""
    sides = F.array(F.struct(F.lit("EARLIER").alias("report_side"), F.col(earlier).alias(name)), F.struct(F.lit("LATER").alias("report_side"), F.col(later).alias(name)))
    return alignments.withColumn("_s", F.explode(sides)).where(F.col(f"_s.{name}").isNotNull()).select("*", "_s.report_side", F.col(f"_s.{name}")).drop("_s")


def pair_features(rows: DataFrame, key: str, categories: Sequence[str], words: str = "words") -> DataFrame:
    """Counts, rates and changes of each category by side, introduced and removed rates, hits of sure rows.

    rows: key, report_side, status, confidence, words and a count column a category. One pass of filtered sums.
    """
    side, status = F.col("report_side"), F.col("status")
    total = lambda c, f: F.coalesce(F.sum(F.when(f, F.col(c))), F.lit(0))
    aggs = [total(words, side == s).alias(f"words_{s.lower()}") for s in ("EARLIER", "LATER")]
    aggs += [total(words, status == s).alias(f"words_{s.lower()}") for s in ("NEW", "REMOVED")]
    for c in categories:
        aggs += [total(c, side == s).alias(f"{c}_{s.lower()}") for s in ("EARLIER", "LATER")] + [total(c, status == s).alias(f"{c}_{s.lower()}") for s in ("NEW", "REMOVED")]
    aggs.append(sum((total(c, F.col("confidence").isin("HIGH", "MEDIUM")) for c in categories), F.lit(0)).alias("sure_hits"))
    out = rows.groupBy(key).agg(*aggs)
    for c in categories:
        for s in ("earlier", "later"):
            out = out.withColumn(f"{c}_rate_{s}", N.rate_per(F.col(f"{c}_{s}"), F.col(f"words_{s}")))
        out = out.withColumn(f"{c}_rate_change", F.col(f"{c}_rate_later") - F.col(f"{c}_rate_earlier"))
        out = out.withColumn(f"{c}_introduction", N.rate_per(F.col(f"{c}_new"), F.col("words_new"))).withColumn(f"{c}_removal", N.rate_per(F.col(f"{c}_removed"), F.col("words_removed")))
    return out


def variants(rows: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """rows once for each variant that keeps them, with the variant's name."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in keep.items()]))
    return rows.withColumn("variant", F.explode(names))


def cumulative_share(df: DataFrame, part: list[str], order: list[Column], value: str) -> DataFrame:
    """Running sum of value over the part's total."""
    w = Window.partitionBy(*part)
    run = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("running", run).withColumn("share", N.ratio(run.cast("double"), F.sum(value).over(w)))


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order in which they first occur."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def best_parent(hits: DataFrame, parent: str, similarity: str, rank: str) -> DataFrame:
    """(parent, best, first_rank, hits): members mapped to their parent, the earliest hit on ties."""
    return hits.groupBy(parent).agg(F.max(similarity).alias("best"), F.min(rank).alias("first_rank"), F.count("*").alias("hits"))


def numeric_severity(text: Column, has_verb: Column) -> Column:
    """TABLE_ROW for numbers in a row, PERCENT for percentages alone, where no verb explains them."""
    numbers = F.regexp_count(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*"))
    words = F.regexp_count(text, F.lit(r"\p{L}{3,}"))
    return F.when(has_verb, F.lit(None)).when((numbers >= 4) & (words <= numbers), F.lit("TABLE_ROW")).when(text.rlike(r"^[^\p{L}]*%[^\p{L}]*$"), F.lit("PERCENT"))
