"""The full build of a pair's change features on literal rows."""

from tidemark.operators import pair_build as B

PAIR = "pair string, gap_months int, is_transition boolean, cosine double, bigram_jaccard double, edit double, diff double, word_change_ratio double, document_quality string, run_status string, run_review_reason string, embedded_earlier long, skipped_earlier long, embedded_later long, skipped_later long"
PASSAGES = "pair string, side string, words long, type string"
ROWS = "pair string, status string, confidence string, earlier_words long, later_words long, earlier_type string, later_type string"
P, H = "PARAGRAPH", "HEADING_WITH_BODY"


def build(spark, pairs, passages, rows):
    return {r.pair: r for r in B.pair_features(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(rows, ROWS), "pair").collect()}


def test_pair_features(spark):
    pairs = [(k, gap, tr, 0.9, 0.5, None, 0.7, -0.25, q, "COMPLETED", None, 9, 1, 8, 2) for k, gap, tr, q in (("a", 12, False, "GOOD"), ("b", 16, True, "GOOD"), ("c", 16, False, "GOOD"), ("d", 12, False, "FAILED"), ("empty", 12, False, "GOOD"))]
    passages, rows = [], []
    for k in "abcd":
        passages += [(k, "earlier", 100, P), (k, "earlier", 30, H), (k, "later", 60, P), (k, "later", 20, P), (k, "later", 50, P)]
        rows += [(k, "UNCHANGED", "HIGH", 100, 60, P, P), (k, "AMBIGUOUS", "HIGH", 30, None, H, None), (k, "NEW", "HIGH", None, 20, None, P), (k, "NEW", "LOW", None, 50, None, P)]
    got = build(spark, pairs, passages, rows)
    a = got["a"]
    assert (a.earlier_passage_count, a.later_passage_count, a.earlier_word_count, a.later_word_count, a.eligible_earlier_passage_count, a.eligible_later_passage_count) == (2, 3, 130, 130, 1, 2)
    assert (a.unchanged_words, a.new_words, a.ambiguous_words, a.eligible_new_words, a.eligible_ambiguous_words) == (80.0, 70.0, 30.0, 50.0, 0.0)
    assert (a.excluded_low_information_count, a.excluded_low_information_words, a.excluded_heading_fragment_count, a.excluded_heading_fragment_words) == (2, 50.0, 1, 30.0)
    assert (a.heading_fragment_share_earlier, a.heading_fragment_share_later) == (0.5, 0.0)
    assert (a.alignment_coverage_count, a.alignment_coverage_words, a.review_required_share) == (1.0, 1.0, 0.25)
    assert abs(a.disclosure_change_score - 0.85 * 50 / 130) < 1e-12 and a.unchanged_rate_count == 0.5
    assert (round(a.metric_disagreement_spread, 9), round(a.cosine_change, 9), a.edit_change, a.word_change_ratio_abs) == (0.4, 0.1, None, 0.25)
    assert (a.feature_quality, a.primary_eligible, a.warning_reasons, a.exclusion_reasons, a.feature_run_status) == ("GOOD", True, None, None, "COMPLETED")
    assert (got["b"].feature_quality, got["b"].warning_reasons, got["b"].primary_eligible) == ("GOOD", "irregular gap on an approved transition-period pair", False)
    assert got["c"].warning_reasons == "irregular reporting gap: unexplained, not a flagged transition period"
    assert got["c"].exclusion_reasons == "feature quality is NEEDS_REVIEW; irregular reporting gap excluded from primary analysis by default"
    assert (got["d"].feature_quality, got["d"].exclusion_reasons) == ("FAILED", "document-level similarity quality is FAILED")
    e = got["empty"]
    assert (e.aligned_passage_count, e.new_words, e.new_rate_words, e.alignment_coverage_words, e.disclosure_change_score, e.primary_eligible) == (0, 0.0, None, None, None, False)


def test_rows_without_pairs_or_types(spark):
    got = build(spark, [("a", None, None, None, None, None, None, None, None, None, None, None, None, None, None)], [("a", None, 3, None), ("x", "later", 3, P)], [("a", None, None, None, None, None, None)])
    assert list(got) == ["a"] and got["a"].irregular_gap and got["a"].aligned_passage_count == 1 and got["a"].embedded_coverage_later is None
