"""The full row of change features of a pair, from two aggregates: one over its passages, one over its alignment rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T

from .features import COVERAGE, LOW_WORDS, WEIGHTS, row_weight

#: Confidence tiers; shares of ambiguous words and of doubtful rows that call for review; months of a regular gap (fixed values).
CONFIDENCE = ("HIGH", "MEDIUM", "LOW", "NEEDS_REVIEW")
AMBIGUOUS_MOST, DOUBTFUL_MOST, GAP = 0.15, 0.25, (9, 15)
#: Embedded share that either side needs (fixed value).
EMBEDDED = 0.80


def _short(words: Column) -> Column:
    return F.coalesce(words < LOW_WORDS, F.lit(False))


def exclusion(earlier: Column, later: Column, earlier_type: Column, later_type: Column) -> Column:
    """Why a row is out of the eligible ones: heading_fragment if every short side is a heading with a body, else
    low_information; null if no side is short. A side that isn't there is never short.
    """
    other = [_short(w) & ~F.coalesce(t == "HEADING_WITH_BODY", F.lit(False)) for w, t in ((earlier, earlier_type), (later, later_type))]
    return F.when(_short(earlier) | _short(later), F.when(other[0] | other[1], F.lit("low_information")).otherwise(F.lit("heading_fragment")))


def _passage_totals(passages: DataFrame, key: str) -> DataFrame:
    aggregates = []
    for side in ("earlier", "later"):
        own = F.col("side") == side
        aggregates += [
            F.count_if(own).alias(f"{side}_passage_count"), F.coalesce(F.sum(F.when(own, F.col("words"))), F.lit(0)).cast("long").alias(f"{side}_word_count"),
            F.count_if(own & ~_short(F.col("words"))).alias(f"eligible_{side}_passage_count"), F.count_if(own & _short(F.col("words")) & (F.col("type") == "HEADING_WITH_BODY")).alias(f"_{side}_fragments"),
        ]
    return passages.groupBy(key).agg(*aggregates)


def _alignment_totals(rows: DataFrame, key: str) -> DataFrame:
    w = row_weight(F.col("status"), F.col("earlier_words"), F.col("later_words"))
    rows = rows.withColumn("_w", w).withColumn("_why", exclusion(*[F.col(c) for c in ("earlier_words", "later_words", "earlier_type", "later_type")]))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_w"))), F.lit(0.0))
    ok = F.col("_why").isNull()
    aggregates = [F.count("*").alias("aligned_passage_count"), F.count_if(ok).alias("eligible_aligned_passage_count")]
    for s in WEIGHTS:
        hit, name = F.col("status") == s, s.lower()
        aggregates += [F.count_if(hit).alias(f"{name}_count"), total(hit).alias(f"{name}_words"), F.count_if(hit & ok).alias(f"eligible_{name}_count"), total(hit & ok).alias(f"eligible_{name}_words")]
    for name, c in (("low_information", ~ok), ("heading_fragment", F.col("_why") == "heading_fragment")):
        aggregates += [F.count_if(c).alias(f"excluded_{name}_count"), total(c).alias(f"excluded_{name}_words")]
    aggregates += [F.count_if(F.col("confidence") == c).alias(f"{c.lower()}_confidence_count") for c in CONFIDENCE]
    sides = F.col("earlier_words").isNotNull().cast("long") + F.col("later_words").isNotNull().cast("long")
    aggregates += [F.sum(sides).alias("_sides"), F.sum(F.coalesce("earlier_words", F.lit(0)) + F.coalesce("later_words", F.lit(0))).alias("_side_words")]
    return rows.groupBy(key).agg(*aggregates)


def _quality(out: DataFrame) -> DataFrame:
    """quality, primary_eligible and the reasons for both; a failed document quality overrides all else."""
    c, two = F.col, lambda x: F.format_string("%.2f", F.col(x))
    failed = F.coalesce(c("document_quality") == "FAILED", F.lit(False))
    weak, gap, transition = F.coalesce(c("run_status") == "COMPLETED_WITH_WARNINGS", F.lit(False)), c("irregular_gap"), F.coalesce(c("is_transition"), F.lit(False))
    below = lambda name, label, least: F.when(c(name) < least, F.concat(F.lit(f"{label} "), two(name), F.lit(f" below threshold ({least:.1f})")))
    above = lambda name, label, most: F.when(c(name) > most, F.concat(F.lit(f"{label} "), two(name), F.lit(f" exceeds tolerance ({most})")))
    review = [
        F.when(c("document_quality") == "NEEDS_REVIEW", F.lit("document-level similarity quality is NEEDS_REVIEW")),
        F.when(gap & ~transition, F.lit("irregular reporting gap: unexplained, not a flagged transition period")),
        below("alignment_coverage_count", "alignment coverage (count)", COVERAGE), below("alignment_coverage_words", "alignment coverage (words)", COVERAGE),
        below("embedded_coverage_earlier", "earlier embedding coverage", EMBEDDED), below("embedded_coverage_later", "later embedding coverage", EMBEDDED),
        above("ambiguous_rate_words", "ambiguous word share", AMBIGUOUS_MOST), above("review_required_share", "low/needs-review confidence share", DOUBTFUL_MOST),
    ]
    notes = [
        F.when(weak, F.concat(F.lit("alignment run completed with warnings: "), F.coalesce(F.nullif("run_review_reason", F.lit("")), F.lit("unspecified")))),
        F.when(gap & transition, F.lit("irregular gap on an approved transition-period pair")),
    ]
    overall = F.lit("document-level similarity quality is FAILED")
    quality = F.when(failed, F.lit("FAILED")).when(F.coalesce(*review).isNotNull(), F.lit("NEEDS_REVIEW")).when(weak, F.lit("USABLE")).otherwise(F.lit("GOOD"))
    out = out.withColumn("feature_quality", quality).withColumn("warning_reasons", F.when(failed, overall).otherwise(T.reasons(*review, *notes)))
    fit = c("feature_quality").isin("GOOD", "USABLE")
    no_score = c("disclosure_change_score").isNull()
    why = T.reasons(
        F.when(~fit, F.concat(F.lit("feature quality is "), c("feature_quality"))), F.when(transition, F.lit("transition-period pair excluded from primary analysis by default")),
        F.when(gap, F.lit("irregular reporting gap excluded from primary analysis by default")), F.when(no_score, F.lit("disclosure_change_score unavailable (insufficient coverage or quality)")),
    )
    return out.withColumn("primary_eligible", fit & ~transition & ~gap & ~no_score).withColumn("exclusion_reasons", F.when(failed, overall).otherwise(why))


def pair_features(pairs: DataFrame, passages: DataFrame, alignments: DataFrame, key: str) -> DataFrame:
    """A row for each pair with all its change features.

    pairs: key, gap_months, is_transition, cosine, bigram_jaccard, edit, diff, word_change_ratio, document_quality,
    run_status, run_review_reason and for each side embedded_ and skipped_ counts; further columns pass through.
    passages: key, side (earlier or later), words, type. alignments: key, status, confidence and words and type of each
    side, null where the side isn't there. A pair without passages or rows has counts of 0 and no rates. Both inputs are
    aggregated before they meet the pairs, so no row of a hot pair is moved.
    """
    c = F.col
    sums = _passage_totals(passages, key).join(_alignment_totals(alignments, key), key, "full_outer")
    out = pairs.join(sums, key, "left").fillna(0, [f for f in sums.columns if f != key])
    for s, w in WEIGHTS.items():
        name = s.lower()
        for kind in ("count", "words"):
            total = reduce(Column.__add__, [c(f"eligible_{x.lower()}_{kind}") for x in WEIGHTS])
            out = out.withColumn(f"{name}_rate_{kind}", N.ratio(c(f"eligible_{name}_{kind}").cast("double"), total))
        out = out.withColumn(f"score_{name}_component", c(f"{name}_rate_words") * w)
    ratio = lambda a, b: N.ratio(a.cast("double"), b)
    out = out.withColumns(
        {
            "alignment_coverage_count": ratio(c("_sides"), c("earlier_passage_count") + c("later_passage_count")), "alignment_coverage_words": ratio(c("_side_words"), c("earlier_word_count") + c("later_word_count")),
            **{f"embedded_coverage_{x}": ratio(F.coalesce(f"embedded_{x}", F.lit(0)), F.coalesce(f"embedded_{x}", F.lit(0)) + F.coalesce(f"skipped_{x}", F.lit(0))) for x in ("earlier", "later")},
            **{f"heading_fragment_share_{x}": ratio(c(f"_{x}_fragments"), c(f"{x}_passage_count")) for x in ("earlier", "later")},
            "high_confidence_share": ratio(c("high_confidence_count"), c("aligned_passage_count")), "review_required_share": ratio(c("low_confidence_count") + c("needs_review_confidence_count"), c("aligned_passage_count")),
            "irregular_gap": ~F.coalesce(c("gap_months").between(*GAP), F.lit(False)),
            **{f"{x}_change": 1.0 - c(x) for x in ("cosine", "bigram_jaccard", "edit", "diff")}, "word_change_ratio_abs": F.abs("word_change_ratio"),
            "metric_disagreement_spread": F.when(F.size(F.array_compact(F.array("cosine", "bigram_jaccard", "edit", "diff"))) >= 2, F.greatest("cosine", "bigram_jaccard", "edit", "diff") - F.least("cosine", "bigram_jaccard", "edit", "diff")),
        }
    )
    enough = (c("alignment_coverage_words") >= COVERAGE) & (c("embedded_coverage_earlier") >= EMBEDDED) & (c("embedded_coverage_later") >= EMBEDDED)
    score = reduce(Column.__add__, [c(f"score_{s.lower()}_component") for s in WEIGHTS])
    out = out.withColumn("disclosure_change_score", F.when(enough & score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    out = _quality(out)
    status = F.when(c("feature_quality") == "GOOD", F.lit("COMPLETED")).otherwise(F.lit("COMPLETED_WITH_WARNINGS"))
    return out.withColumn("feature_run_status", status).drop("_sides", "_side_words", "_earlier_fragments", "_later_fragments")
