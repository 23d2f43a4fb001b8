"""The full build of a pair's language features on literal rows."""

import pytest

from tidemark.operators import language_build as G

HITS = (*G.CORE, *G.CUSTOM)
PAIR = "pair string, is_transition boolean, irregular_gap boolean, run_status string, run_review_reason string, feature_quality string"
ROW = "pair string, report_side string, status string, confidence string, words long, category string, feature_eligible boolean, collision boolean, total_hits long, " + ", ".join(f"{x} long" for x in HITS)


def row(side, status, words, category=None, confidence="HIGH", eligible=True, collision=False, **hits):
    return ("p", side, status, confidence, words, category, eligible, collision, sum(hits.values()), *[hits.get(x, 0) for x in HITS])


def build(spark, rows, pair=("p", False, False, "COMPLETED", None, "GOOD")):
    return G.pair_language_features(spark.createDataFrame([pair], PAIR), spark.createDataFrame(rows, ROW), "pair").collect()


ROWS = [
    row("EARLIER", "UNCHANGED", 1000, positive=60, negative=20, uncertainty=10),
    row("LATER", "UNCHANGED", 1000, positive=50, negative=40, weak_modal=5),
    row("LATER", "NEW", 500, negative=10, risk=5, confidence="MEDIUM"),
    row("EARLIER", "REMOVED", 250, positive=10, confidence="NEEDS_REVIEW"),
    row("LATER", "UNCHANGED", 300, "list_content", governance=30),
    row("LATER", "UNCHANGED", 400, "caption_or_label_like", positive=99),
    row("LATER", "UNCHANGED", 30, eligible=False, positive=9),
    row("EARLIER", "AMBIGUOUS", 200, confidence="LOW", uncertainty=20),
]


def test_populations_and_rates(spark):
    (r,) = build(spark, ROWS)
    assert (r.all_passages_earlier_count, r.all_passages_later_count, r.all_passages_earlier_words, r.all_passages_later_words) == (3, 5, 1450, 2230)
    assert (r.primary_narrative_later_count, r.primary_narrative_later_words, r.excluded_structured_content_count, r.excluded_structured_content_words) == (4, 1830, 1, 400)
    assert (r.list_content_count, r.list_content_words, r.primary_narrative_words_excluding_lists, r.alignment_change_analyzed_words_all) == (1, 300, 2950, 3250)
    assert (r.positive_count_earlier, r.positive_count_later, r.negative_hits_new, r.positive_hits_removed, r.uncertainty_hits_ambiguous) == (70, 50, 10, 10, 20)
    assert r.positive_rate_earlier == pytest.approx(70 / 1.45) and r.positive_rate_later == pytest.approx(50 / 1.8)
    assert r.net_tone_change == pytest.approx((50 - 50) / 1.8 - (70 - 20) / 1.45)
    assert (r.negative_language_introduction, r.risk_language_introduction, r.positive_language_removal, r.negative_language_removal) == (20.0, 10.0, 40.0, 0.0)
    assert r.forward_looking_caution_change == pytest.approx(5 / 1.8 - 30 / 1.45) and r.governance_rate_later == pytest.approx(30 / 1.8)
    assert (r.alignment_change_analyzed_words_excl_ambiguous, r.alignment_change_analyzed_words_hml, r.alignment_change_analyzed_words_hm, r.alignment_change_analyzed_words_h) == (3050, 3000, 2800, 2300)
    assert (r.high_confidence_dictionary_hits, r.high_and_medium_confidence_dictionary_hits) == (215, 230)
    assert r.substantially_modified_positive_rate_change is None
    assert (r.report_side_signal_quality, r.alignment_change_signal_quality, r.primary_eligible, r.warning_reasons) == ("GOOD", "GOOD", True, None)


def test_reasons(spark):
    (r,) = build(spark, [row("EARLIER", "AMBIGUOUS", 100, positive=1, collision=True), row("LATER", "UNCHANGED", 100, positive=3), row("LATER", "UNCHANGED", 100, "caption_or_label_like")], ("p", True, True, "COMPLETED_WITH_WARNINGS", "one; two", "NEEDS_REVIEW"))
    assert r.report_side_warning_reasons == "later primary-narrative word coverage 0.50 below threshold (0.7); earlier dictionary match rate 0.010 is anomalously low (< 0.02); later dictionary match rate 0.030 is borderline (< 0.05) -- plausible but worth spot-checking; irregular gap on an approved transition-period pair"
    assert r.alignment_change_warning_reasons.startswith("ambiguous word share 0.50 exceeds tolerance (0.15)") and "warnings: one; two; upstream feature quality is NEEDS_REVIEW" in r.alignment_change_warning_reasons
    assert r.exclusion_reasons.split("; ")[0] == "[report-side] report-side quality is NEEDS_REVIEW" and "[alignment-change] alignment-change quality is NEEDS_REVIEW" in r.exclusion_reasons
    (r,) = build(spark, ROWS, ("p", False, False, None, None, "FAILED"))
    assert (r.language_signal_quality, r.report_side_signal_quality, r.primary_eligible, r.exclusion_reasons) == ("FAILED", "GOOD", False, "[alignment-change] upstream feature quality is FAILED")


def test_pair_without_rows(spark):
    (r,) = build(spark, [], ("p", None, None, None, None, None))
    assert (r.all_passages_earlier_words, r.positive_rate_earlier, r.net_tone_change, r.dictionary_match_rate, r.list_content_share, r.language_signal_quality) == (0, None, None, None, 0.0, "GOOD")
