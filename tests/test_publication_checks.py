"""A small sound publication passes every check, and each fault is found by its own check alone."""

import copy
import datetime as dt
import hashlib

import pytest

from tidemark.operators.publication_checks import publication_checks

SCHEMAS = {
    "companies": "id string, source_company_id long",
    "reports": "id string, company_id string, source_report_id long",
    "comparisons": "id string, company_id string, source_report_pair_id long, earlier_report_id string, later_report_id string, earlier_period_end date, later_period_end date, chronological_index int, is_latest_for_company boolean, report_side_quality string, report_side_quality_label string, report_side_primary_eligible boolean, alignment_change_quality string, alignment_change_quality_label string, alignment_change_primary_eligible boolean, disclosure_change_quality string, disclosure_change_quality_label string, disclosure_change_primary_eligible boolean, disclosure_change_score double, is_irregular_gap boolean",
    "passages": "id string, report_id string, structured_content_category string, search_vector string, text string",
    "passage_comparisons": "id string, source_alignment_id long, earlier_passage_id string, later_passage_id string, alignment_status string",
    "discovery_items": "discovery_type string, rank_scope string, company_id string, rank int, supporting_metric_key string, report_comparison_id string",
    "metric_definitions": "metric_key string",
    "embeddings": "id string, passage_id string, embedding_model string, embedding_model_revision string, dimensions int, embedding array<float>, embedding_text_hash string",
    "contexts": "id string, passage_id string, passage_embedding_id string, context_type string, passage_comparison_id string, report_comparison_id string, report_side string, report_side_quality string, alignment_change_quality string, irregular_gap_flag boolean",
    "signals": "passage_comparison_id string, report_side string, category string, subcategory string, adjusted_count int",
    "context_categories": "id string, retrieval_context_id string, category string",
    "context_risks": "id string, retrieval_context_id string, subcategory string",
    "qa_chunks": "id string, report_id string, company_id string, chunk_index int, page_start int, page_end int, dimensions int, embedding array<float>, text string, embedding_text_hash string",
    "qa_chunk_passages": "id string, qa_chunk_id string, passage_id string",
}
VECTOR = [0.1] * 384
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def sound():
    day = dt.date
    good = ["GOOD", "Analysis ready", True, "USABLE", "Usable attribution", True, "GOOD", "Analysis ready", True, 0.5, False]
    return {
        "companies": [["c1", 1], ["c2", 2]],
        "reports": [["r1", "c1", 1], ["r2", "c1", 2], ["r3", "c1", 3], ["r4", "c2", 4]],
        "comparisons": [["x1", "c1", 1, "r1", "r2", day(2020, 1, 1), day(2021, 1, 1), 0, False, *good], ["x2", "c1", 2, "r2", "r3", day(2021, 1, 1), day(2022, 1, 1), 1, True, *good]],
        "passages": [[f"p{i}", f"r{i}", None, "v", f"text {i}"] for i in range(1, 5)],
        "passage_comparisons": [["y1", 1, "p1", "p2", "UNCHANGED"], ["y2", 2, None, "p2", "NEW"], ["y3", 3, "p1", None, "REMOVED"]],
        "discovery_items": [["largest_overall_change", "all", "c1", 1, "m", "x1"], ["largest_overall_change", "all", "c1", 2, "m", "x2"], ["other", "company_history", "c1", 1, "m", None]],
        "metric_definitions": [["m"]],
        "embeddings": [[f"e{i}", f"p{i}", "model", "1", 384, VECTOR, sha(f"text {i}")] for i in range(1, 5)],
        "contexts": [["k1", "p2", "e2", "COMPARISON_LINKED", "y2", "x1", "LATER", "GOOD", "USABLE", False], ["k2", "p1", "e1", "COMPARISON_LINKED", "y3", "x1", "EARLIER", "GOOD", "USABLE", False], ["k3", "p3", "e3", "REPORT_ONLY", None, None, None, None, None, None]],
        "signals": [["y2", "LATER", "risk", "credit", 2], ["y2", "LATER", "positive", None, 1], ["y3", "EARLIER", "risk", "credit", 0]],
        "context_categories": [["t1", "k1", "risk"], ["t2", "k1", "positive"]],
        "context_risks": [["u1", "k1", "credit"]],
        "qa_chunks": [["q1", "r1", "c1", 0, 1, 2, 384, VECTOR, "chunk", sha("chunk")], ["q2", "r1", "c1", 1, 2, 2, 384, VECTOR, "more", sha("more")]],
        "qa_chunk_passages": [["m1", "q1", "p1"], ["m2", "q2", "p1"]],
    }


def failing(spark, data):
    tables = {k: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[k]) for k, rows in data.items()}
    got = publication_checks(tables).collect()
    assert len({r.check_name for r in got}) == len(got) == 59
    assert all(r.failures <= r.checked for r in got)
    return {r.check_name: r.failures for r in got if r.failures}


def test_a_sound_and_an_empty_publication_pass(spark):
    assert failing(spark, sound()) == {}
    assert failing(spark, {k: [] for k in SCHEMAS}) == {}


FAULTS = {
    "companies": ([("companies", 1, 1, 1), ("reports", 3, 1, "c1"), ("comparisons", 1, 2, 1), ("reports", 2, 2, 1), ("passage_comparisons", 1, 1, 1)], {"no_duplicate_source_company_id": 1, "company_has_report": 1, "no_duplicate_source_pair_id": 1, "no_duplicate_source_report_id": 1, "no_duplicate_source_alignment_id": 1}),
    "comparisons": ([("comparisons", 0, 3, "gone"), ("comparisons", 1, 4, "r4"), ("comparisons", 0, 6, dt.date(2020, 1, 1)), ("comparisons", 1, 7, 2), ("comparisons", 0, 8, True)], {"comparison_reports_exist": 1, "comparison_same_company": 1, "comparison_period_order": 1, "chronological_index_contiguous": 1, "exactly_one_latest_per_company": 1}),
    "qualities": ([("comparisons", 1, 10, "Fine"), ("comparisons", 1, 12, "NEEDS_REVIEW"), ("comparisons", 1, 13, "Analysis ready"), ("comparisons", 1, 15, "FAILED"), ("comparisons", 0, 15, None), ("comparisons", 0, 16, "?")], {"report_side_quality_label_in_vocabulary": 1, "alignment_change_primary_eligible_implies_ok_quality": 1, "alignment_change_quality_label_in_vocabulary": 1, "disclosure_change_failed_quality_implies_no_displayed_score": 1, "disclosure_change_primary_eligible_implies_ok_quality": 1, "disclosure_change_quality_always_present": 1, "disclosure_change_quality_label_in_vocabulary": 1}),
    "passages": ([("passages", 0, 2, "broken_fragment_sequence"), ("passages", 1, 3, None), ("passage_comparisons", 0, 2, None), ("passage_comparisons", 1, 2, "p1"), ("passage_comparisons", 2, 2, None)], {"no_excluded_categories_published": 1, "search_vectors_populated": 1, "matched_status_has_both_sides": 1, "new_has_no_earlier_passage": 1, "passage_comparison_one_side_present": 1, "retrieval_context_side_matches_passage_comparison_side": 1}),
    "discoveries": ([("discovery_items", 1, 3, 3), ("discovery_items", 2, 4, "none"), ("discovery_items", 0, 5, "gone")], {"discovery_rank_contiguous": 1, "metric_definition_exists_for_discovery": 1, "feature_gated_discovery_excludes_non_primary_eligible": 1}),
    "embeddings": ([("embeddings", 0, 6, "?"), ("embeddings", 1, 5, [0.0] * 384), ("embeddings", 2, 4, 3), ("embeddings", 3, 1, "p3")], {"passage_embedding_text_hash_self_consistent": 2, "passage_embedding_vector_not_zero": 1, "passage_embedding_dimensions_match_configured_column": 1, "no_duplicate_passage_embeddings": 1, "embedding_coverage_meets_minimum": 1}),
    "contexts": ([("contexts", 0, 6, "EARLIER"), ("contexts", 1, 5, "x9"), ("contexts", 2, 2, "e1"), ("contexts", 2, 5, "x1")], {"retrieval_context_side_matches_passage_comparison_side": 1, "new_context_is_later_side": 1, "retrieval_context_quality_matches_parent_comparison": 1, "retrieval_context_references_published_embedding": 1, "report_only_context_has_no_comparison_fields": 1, "retrieval_context_language_categories_match_passage_language_signals": 1, "retrieval_context_risk_subcategories_match_passage_language_signals": 1}),
    "tags": ([("context_categories", 1, 1, "none"), ("signals", 2, 4, 1), ("context_risks", 0, 1, "none")], {"retrieval_context_category_references_published_context": 1, "retrieval_context_risk_subcategory_references_published_context": 1, "retrieval_context_language_categories_match_passage_language_signals": 2, "retrieval_context_risk_subcategories_match_passage_language_signals": 2}),
    "chunks": ([("qa_chunks", 0, 2, "c2"), ("qa_chunks", 0, 4, 3), ("qa_chunks", 1, 3, 0), ("qa_chunks", 1, 8, "chunk"), ("qa_chunks", 1, 9, sha("chunk")), ("qa_chunk_passages", 0, 1, "q9"), ("qa_chunk_passages", 1, 2, "p2")], {"qa_chunk_company_matches_report_company": 1, "qa_chunk_page_range_valid": 1, "no_duplicate_qa_chunk_index": 1, "no_duplicate_qa_chunk_text_hash_within_report": 1, "qa_chunk_passage_references_published_chunk": 1, "qa_chunk_has_complete_source_lineage": 1, "qa_chunk_passage_same_report": 1}),
}


@pytest.mark.parametrize("name", FAULTS)
def test_faults_are_found(spark, name):
    data = copy.deepcopy(sound())
    for table, row, column, value in FAULTS[name][0]:
        data[table][row][column] = value
    assert failing(spark, data) == FAULTS[name][1]
