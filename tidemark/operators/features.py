"""Change features of a pair: outcomes, rates, weighted score, coverage and the quality rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T

#: Alignment statuses in their fixed order with their weight in the change score (fixed values).
WEIGHTS = {"UNCHANGED": 0.0, "LIGHTLY_MODIFIED": 0.25, "SUBSTANTIALLY_MODIFIED": 0.65, "NEW": 0.85, "REMOVED": 0.85, "AMBIGUOUS": 0.5}
MATCHED = ("UNCHANGED", "LIGHTLY_MODIFIED", "SUBSTANTIALLY_MODIFIED")
#: Words below which a passage says little, coverage that a score needs (fixed values).
LOW_WORDS, COVERAGE = 40, 0.80


def row_weight(status: Column, earlier: Column, later: Column) -> Column:
    """Words that a row adds to its status: the later side's if new, the earlier's if removed, the one that is there if
    ambiguous (the earlier of two), else the mean of those that are there; 0 without any.
    """
    mean = F.when(earlier.isNotNull() & later.isNotNull(), (earlier + later) / 2.0).otherwise(F.coalesce(earlier, later))
    words = F.when(status == "NEW", later).when(status == "REMOVED", earlier).when(status == "AMBIGUOUS", F.coalesce(earlier, later)).otherwise(mean)
    return F.coalesce(words.cast("double"), F.lit(0.0))


def eligible(earlier: Column, later: Column) -> Column:
    """Every side that is there has enough words."""
    return F.coalesce(earlier >= LOW_WORDS, F.lit(True)) & F.coalesce(later >= LOW_WORDS, F.lit(True))


def outcomes(rows: DataFrame, key: list[str], status: str = "status", earlier: str = "earlier_words", later: str = "later_words") -> DataFrame:
    """Counts and words of each status for a key, all rows and eligible ones, in one pre-aggregated pass."""
    w, ok = row_weight(F.col(status), F.col(earlier), F.col(later)), eligible(F.col(earlier), F.col(later))
    each = []
    for s in WEIGHTS:
        hit, name = F.col(status) == s, s.lower()
        each += [
            F.count_if(hit).alias(f"{name}_count"), F.coalesce(F.sum(F.when(hit, w)), F.lit(0.0)).alias(f"{name}_words"),
            F.count_if(hit & ok).alias(f"eligible_{name}_count"), F.coalesce(F.sum(F.when(hit & ok, w)), F.lit(0.0)).alias(f"eligible_{name}_words"),
        ]
    return rows.groupBy(*key).agg(*each)


def rates(kind: str = "words", prefix: str = "eligible_") -> dict[str, Column]:
    """Each status over the sum of all six; null if the sum is 0."""
    total = sum((F.col(f"{prefix}{s.lower()}_{kind}") for s in list(WEIGHTS)[1:]), F.col(f"{prefix}unchanged_{kind}"))
    return {s: N.ratio(F.col(f"{prefix}{s.lower()}_{kind}").cast("double"), total) for s in WEIGHTS}


def score(shares: dict[str, Column], coverage: Column) -> Column:
    """Weighted sum of the rates within [0, 1]; null if a rate is null or coverage is short."""
    total = sum((shares[s] * w for s, w in list(WEIGHTS.items())[1:]), shares["UNCHANGED"] * WEIGHTS["UNCHANGED"])
    return F.when(total.isNotNull() & (coverage >= COVERAGE), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def coverage(rows: DataFrame, key: list[str], status: str = "status", earlier: str = "earlier_words", later: str = "later_words") -> DataFrame:
    """Words of matched sides over all words of the rows, both sides added, and the same in passages.

    What share of all passages the rows represent is a measure of the full build (pair_build).
    """
    on = F.col(status).isin(*MATCHED)
    sides = F.array(F.col(earlier), F.col(later))
    words = F.coalesce(sides[0], F.lit(0)) + F.coalesce(sides[1], F.lit(0))
    count = sides[0].isNotNull().cast("long") + sides[1].isNotNull().cast("long")
    agg = rows.groupBy(*key).agg(F.sum(F.when(on, words).otherwise(0)).alias("cw"), F.sum(words).alias("w"), F.sum(F.when(on, count).otherwise(0)).alias("cn"), F.sum(count).alias("n"))
    return agg.select(*key, N.ratio(F.col("cw").cast("double"), F.col("w")).alias("coverage_words"), N.ratio(F.col("cn").cast("double"), F.col("n")).alias("coverage_count"))


def dominant(values: dict[str, Column]) -> Column:
    """Name of the largest value, the first in order on ties; nulls don't take part."""
    best = F.greatest(*[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k"))) for i, (k, v) in enumerate(values.items())])
    return best["k"]


def alignment_status(semantic: Column, lexical: Column, length: Column) -> Column:
    """Unchanged needs all three high; lightly modified a high semantic similarity; else substantially modified."""
    same = (semantic >= 0.95) & (F.coalesce(lexical, F.lit(0.0)) >= 0.90) & (F.coalesce(length, F.lit(0.0)) >= 0.85)
    return F.when(same, F.lit("UNCHANGED")).when(semantic >= 0.85, F.lit("LIGHTLY_MODIFIED")).otherwise(F.lit("SUBSTANTIALLY_MODIFIED"))


def disagreement(semantic: Column, lexical: Column) -> Column:
    """A note where meaning and wording tell different stories."""
    return F.when((semantic >= 0.85) & (lexical <= 0.40), F.lit("high semantic, low lexical")).when((semantic <= 0.55) & (lexical >= 0.75), F.lit("low semantic, high lexical"))


def alignment_confidence(margin: Column, *doubts: Column, reasons: tuple[Column, ...] = ()) -> Column:
    """Doubts need review; a narrow margin is low; a modest one, or any reason, is medium. No next candidate is a margin of 1."""
    m = F.coalesce(margin, F.lit(1.0))
    doubt, reason = F.lit(False), F.lit(False)
    for d in doubts:
        doubt = doubt | d.isNotNull()
    for r in reasons:
        reason = reason | r.isNotNull()
    return F.when(doubt, F.lit("NEEDS_REVIEW")).when(m < 0.03, F.lit("LOW")).when((m < 0.08) | reason, F.lit("MEDIUM")).otherwise(F.lit("HIGH"))


def feature_quality(covered: Column, ambiguous: Column, low_confidence: Column, gap: Column, document: Column) -> tuple[Column, Column]:
    """(quality, reasons)."""
    why = T.reasons(
        F.when(covered.isNull() | (covered < COVERAGE), F.lit("insufficient coverage")), F.when(ambiguous > 0.15, F.lit("many ambiguous alignments")),
        F.when(low_confidence > 0.25, F.lit("many low-confidence alignments")), F.when(N.irregular(gap), F.lit("irregular gap")), F.when(document == "NEEDS_REVIEW", F.lit("document quality")),
    )
    status = F.when(document == "FAILED", F.lit("FAILED")).when(why.isNotNull(), F.lit("NEEDS_REVIEW")).otherwise(F.lit("GOOD"))
    return status, why


#: Order of quality tiers, worst first (fixed values).
TIERS = ("FAILED", "NEEDS_REVIEW", "USABLE", "GOOD")


def tier(quality: Column) -> Column:
    """Ordinal of a quality; null for an unknown one."""
    out = F.lit(None).cast("int")
    for i, q in reversed(list(enumerate(TIERS))):
        out = F.when(quality == q, F.lit(i)).otherwise(out)
    return out


def stricter(a: Column, b: Column) -> Column:
    """The worse of two qualities."""
    return F.get(F.array(*[F.lit(q) for q in TIERS]), F.when(tier(a).isNotNull() & tier(b).isNotNull(), F.least(tier(a), tier(b))))


def meets(quality: Column, least: str | None) -> Column:
    """Whether quality is at least that; a null quality fails where a minimum is set."""
    return F.lit(True) if least is None else F.coalesce(tier(quality) >= TIERS.index(least), F.lit(False))


def collision(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).rlike("duplicat|boilerplate|disambiguat|arbitrary"), F.lit(False))
