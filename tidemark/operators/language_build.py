"""The full row of language features of a pair: ten populations of its signal rows in one pass of filtered sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T

from .features import stricter

#: Dictionary categories and those of the taxonomy (fixed values).
CORE = ("positive", "negative", "uncertainty", "litigious", "constraining", "strong_modal", "weak_modal")
CUSTOM = ("risk", "financial_condition", "governance", "strategy")
#: Structured content that is no primary narrative (fixed values).
EXCLUDED = (
    "short_fragment_invalid", "broken_fragment_sequence", "numeric_or_table_like_source",
    "contents_or_index_like", "caption_or_label_like", "financial_table_rendered_as_prose",
)
#: Kinds of structured content counted by themselves, by the name of their columns (fixed values).
KINDS = {"list_content": "list_content", "table_context": "table_context", "currency_exposure_mixed": "currency_exposure_table_mixed", "uncertain": "uncertain"}
WITHOUT = {"lists": "list_content", "table_context": "table_context", "currency_exposure_mixed": "currency_exposure_table_mixed", "uncertain": "uncertain"}
#: Least share of primary narrative, match rates that are anomalous and borderline (fixed values).
NARRATIVE, MATCH_LOW, MATCH_FAIR = 0.70, 0.02, 0.05
#: Most share of ambiguous words, shares of collisions that warn and that call for review, share of unmatched words (fixed values).
AMBIGUOUS, COLLIDING, COLLIDING_MOST, UNMATCHED = 0.15, 0.60, 0.85, 0.40

TRANSITION = "transition-period pair excluded from primary analysis by default"
IRREGULAR = "irregular reporting gap excluded from primary analysis by default"


def _sums(rows: DataFrame, key: str) -> DataFrame:
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    side = {s: c("report_side") == s.upper() for s in ("earlier", "later")}
    primary = ~yes(c("category").isin(*EXCLUDED))
    ok = primary & yes(c("feature_eligible"))
    kind = lambda k: yes(c("category") == k)
    status = lambda s: ok & (c("status") == s.upper())
    sure = lambda *s: ok & yes(c("confidence").isin(*s))
    total = lambda x, cond: F.coalesce(F.sum(F.when(cond, c(x))), F.lit(0)).cast("long")
    out: dict[str, Column] = {}
    for name, cond in (("all_passages", F.lit(True)), ("primary_narrative", primary)):
        for s, on in side.items():
            out[f"{name}_{s}_count"], out[f"{name}_{s}_words"] = F.count_if(cond & on), total("words", cond & on)
    for name, cond in (("excluded_structured_content", ~primary), *((n, kind(k)) for n, k in KINDS.items())):
        out[f"{name}_count"], out[f"{name}_words"] = F.count_if(cond), total("words", cond)
    for name, k in WITHOUT.items():
        out[f"primary_narrative_words_excluding_{name}"] = total("words", ok & ~kind(k))
    for s, on in side.items():
        out[f"_words_{s}"], out[f"_hits_{s}"] = total("words", ok & on), total("total_hits", ok & on)
        for x in (*CORE, *CUSTOM):
            out[f"{x}_count_{s}"] = total(x, ok & on)
        out[f"_changed_words_{s}"] = total("words", status("substantially_modified") & on)
        for x in ("positive", "negative", "uncertainty"):
            out[f"_changed_{x}_{s}"] = total(x, status("substantially_modified") & on)
    for s in ("new", "removed", "ambiguous"):
        out[f"_words_{s}"] = total("words", status(s))
        for x in (*CORE, "risk"):
            out[f"{x}_hits_{s}"] = total(x, status(s))
    out["high_confidence_dictionary_hits"] = total("total_hits", sure("HIGH"))
    out["high_and_medium_confidence_dictionary_hits"] = total("total_hits", sure("HIGH", "MEDIUM"))
    out["_hits"], out["_colliding"] = total("total_hits", ok), total("words", ok & yes(c("collision")))
    populations = {"all": ok, "excl_ambiguous": ok & ~yes(c("status") == "AMBIGUOUS"), "hml": ok & ~yes(c("confidence") == "NEEDS_REVIEW"), "hm": sure("HIGH", "MEDIUM"), "h": sure("HIGH")}
    for name, cond in populations.items():
        out[f"alignment_change_analyzed_words_{name}"] = total("words", cond)
    return rows.groupBy(key).agg(*[v.alias(k) for k, v in out.items()])


def _rates(out: DataFrame) -> DataFrame:
    c = F.col
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    per = lambda x, words: N.rate_per(c(x), c(words))
    out = out.withColumns({f"{x}_rate_{s}": per(f"{x}_count_{s}", f"_words_{s}") for x in (*CORE, *CUSTOM) for s in ("earlier", "later")})
    change = lambda x: c(f"{x}_rate_later") - c(f"{x}_rate_earlier")
    total = c("alignment_change_analyzed_words_all")
    both, narrative = (c(f"{n}_earlier_words") + c(f"{n}_later_words") for n in ("all_passages", "primary_narrative"))
    introduced = {f"{x}_language_{n}": per(f"{x}_hits_{s}", f"_words_{s}") for x in ("negative", "positive", "risk") for n, s in (("introduction", "new"), ("removal", "removed"))}
    out = out.withColumns(
        {
            **{f"{x}_rate_change": change(x) for x in CORE}, **{f"{x}_rate_change_abs": F.abs(change(x)) for x in CORE},
            **{f"substantially_modified_{x}_rate_change": per(f"_changed_{x}_later", "_changed_words_later") - per(f"_changed_{x}_earlier", "_changed_words_earlier") for x in ("positive", "negative", "uncertainty")},
            **{f"net_tone_{s}": c(f"positive_rate_{s}") - c(f"negative_rate_{s}") for s in ("earlier", "later")}, **introduced, "uncertainty_intensity_change": change("uncertainty"),
            "forward_looking_caution_change": (c("uncertainty_rate_later") + c("weak_modal_rate_later")) - (c("uncertainty_rate_earlier") + c("weak_modal_rate_earlier")),
            "governance_language_change": change("governance"), "financial_condition_language_change": change("financial_condition"),
            "analyzed_word_coverage": share(both, both), "primary_narrative_coverage": share(narrative, both), "dictionary_match_rate": share(c("_hits"), total),
            **{f"dictionary_match_rate_{s}": share(c(f"_hits_{s}"), c(f"_words_{s}")) for s in ("earlier", "later")}, **{f"_narrative_{s}": share(c(f"primary_narrative_{s}_words"), c(f"all_passages_{s}_words")) for s in ("earlier", "later")},
            "list_content_share": share(c("list_content_words"), F.greatest(total, F.lit(1))), "uncertain_content_share": share(c("uncertain_words"), F.greatest(total, F.lit(1))),
            "ambiguous_alignment_share": share(c("_words_ambiguous"), total), "collision_flagged_word_share": share(c("_colliding"), total), "unmatched_word_share": share(c("_words_new") + c("_words_removed"), total),
            "ambiguous_words_in_report_side": c("_words_ambiguous"),
        }
    )
    return out.withColumn("net_tone_change", c("net_tone_later") - c("net_tone_earlier"))


def _note(value: str, when: Column, label: str, digits: int, tail: str) -> Column:
    return F.when(when, F.concat(F.lit(f"{label} "), F.format_string(f"%.{digits}f", F.col(value)), F.lit(f" {tail}")))


def _assessed(out: DataFrame, layer: str, label: str, review: list[Column], informative: list[Column], weak: Column, failed: Column) -> DataFrame:
    """The quality of a layer with why, and whether it is fit for the primary analysis with why not."""
    gap, transition = F.col("irregular_gap"), F.col("is_transition")
    context = F.when(gap & transition, F.lit("irregular gap on an approved transition-period pair"))
    overall = F.lit("upstream feature quality is FAILED")
    quality = F.when(failed, F.lit("FAILED")).when(F.coalesce(*review).isNotNull(), F.lit("NEEDS_REVIEW")).when(weak | F.coalesce(*informative).isNotNull(), F.lit("USABLE")).otherwise(F.lit("GOOD"))
    name = f"{layer}_signal_quality"
    out = out.withColumn(name, quality).withColumn(f"{layer}_warning_reasons", F.when(failed, overall).otherwise(T.reasons(*review, *informative, context)))
    fit = F.col(name).isin("GOOD", "USABLE")
    why = T.reasons(F.when(~fit, F.concat(F.lit(f"{label} quality is "), F.col(name))), F.when(transition, F.lit(TRANSITION)), F.when(gap, F.lit(IRREGULAR)))
    return out.withColumn(f"{layer}_primary_eligible", fit & ~transition & ~gap).withColumn(f"{layer}_exclusion_reasons", F.when(failed, overall).otherwise(why))


def _prefixed(column: str, prefix: str) -> Column:
    return F.concat(F.lit(f"[{prefix}] "), F.replace(F.col(column), F.lit("; "), F.lit(f"; [{prefix}] ")))


def pair_language_features(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A row for each pair with all its language features, and three qualities: of the sides, of the change, of both.

    pairs: key, is_transition, irregular_gap, run_status, run_review_reason, feature_quality; further columns pass through.
    rows: key, report_side (EARLIER or LATER), status, confidence, words, category (of structured content, or null),
    feature_eligible, collision, total_hits and a count for each of CORE and CUSTOM. Rates are by 1,000 words over eligible
    primary narrative; null without words. A pair without rows has counts of 0. A null flag is false.
    """
    c = F.col
    sums = _sums(rows, key)
    out = pairs.withColumns({x: F.coalesce(c(x), F.lit(False)) for x in ("is_transition", "irregular_gap")})
    out = _rates(out.join(sums, key, "left").fillna(0, [x for x in sums.columns if x != key]))
    unexplained = F.when(c("irregular_gap") & ~c("is_transition"), F.lit("irregular reporting gap: unexplained, not a flagged transition period"))
    review, informative = [unexplained], []
    for s in ("earlier", "later"):
        review.append(_note(f"_narrative_{s}", c(f"_narrative_{s}") < NARRATIVE, f"{s} primary-narrative word coverage", 2, f"below threshold ({NARRATIVE})"))
    for s in ("earlier", "later"):
        rate = c(f"dictionary_match_rate_{s}")
        review.append(_note(f"dictionary_match_rate_{s}", rate < MATCH_LOW, f"{s} dictionary match rate", 3, f"is anomalously low (< {MATCH_LOW})"))
        informative.append(_note(f"dictionary_match_rate_{s}", (rate >= MATCH_LOW) & (rate < MATCH_FAIR), f"{s} dictionary match rate", 3, f"is borderline (< {MATCH_FAIR}) -- plausible but worth spot-checking"))
    out = _assessed(out, "report_side", "report-side", review, informative, F.lit(False), F.lit(False))
    collide = c("collision_flagged_word_share")
    weak = F.coalesce(c("run_status") == "COMPLETED_WITH_WARNINGS", F.lit(False))
    informative = [
        F.when(weak, F.concat(F.lit("alignment run completed with warnings: "), F.coalesce(F.nullif("run_review_reason", F.lit("")), F.lit("unspecified")))),
        F.when(c("feature_quality") == "NEEDS_REVIEW", F.lit("upstream feature quality is NEEDS_REVIEW")),
        _note("collision_flagged_word_share", (collide > COLLIDING) & (collide <= COLLIDING_MOST), "collision-flagged word share", 2, f"above {COLLIDING} -- non-unique correspondence (duplicate/boilerplate content), not a demonstrated mismatch"),
        _note("unmatched_word_share", c("unmatched_word_share") > UNMATCHED, "unmatched word share", 2, f"above {UNMATCHED} -- high content turnover, not necessarily a defect"),
    ]
    review = [
        unexplained, _note("ambiguous_alignment_share", c("ambiguous_alignment_share") > AMBIGUOUS, "ambiguous word share", 2, f"exceeds tolerance ({AMBIGUOUS}) -- genuine non-correspondence, not just non-uniqueness"),
        _note("collision_flagged_word_share", collide > COLLIDING_MOST, "collision-flagged word share", 2, f"exceeds tolerance ({COLLIDING_MOST})"),
    ]
    out = _assessed(out, "alignment_change", "alignment-change", review, informative, weak, F.coalesce(c("feature_quality") == "FAILED", F.lit(False)))
    out = out.withColumn("language_signal_quality", stricter(c("report_side_signal_quality"), c("alignment_change_signal_quality"))).withColumn("primary_eligible", c("report_side_primary_eligible") & c("alignment_change_primary_eligible"))
    for x in ("warning", "exclusion"):
        out = out.withColumn(f"{x}_reasons", T.reasons(_prefixed(f"report_side_{x}_reasons", "report-side"), _prefixed(f"alignment_change_{x}_reasons", "alignment-change")))
    return out.drop(*[x for x in out.columns if x.startswith("_")], *[f"risk_hits_{s}" for s in ("new", "removed", "ambiguous")], *[f"{x}_count_{s}" for x in CUSTOM for s in ("earlier", "later")])
