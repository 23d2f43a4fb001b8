"""The accepted and current rows of every table, on a literal set of runs."""

from tidemark.sources.snapshot import snapshot

RUN = ", status string, completed_at int"
SCHEMAS = {
    "companies": "company_id string", "reports": "report_id string, company_id string, metadata_status string", "pairs": "pair_id string, earlier_report_id string, later_report_id string",
    "segmentation_runs": "run_id string, report_id string" + RUN, "embedding_runs": "run_id string, segmentation_run_id string" + RUN,
    "feature_runs": "run_id string, pair_id string, alignment_run_id string" + RUN, "language_runs": "run_id string, pair_id string, alignment_run_id string" + RUN,
    "passages": "passage_id string, run_id string, text string, heading string, passage_type string, list_item boolean", "embeddings": "passage_id string, run_id string, vector array<double>",
    "alignments": "alignment_run_id string, primary_alignment boolean, l_idx int", "features": "run_id string, pair_id string, score double",
    "language": "run_id string, pair_id string, tone double", "signals": "run_id string, hits int",
}
DATA = {
    "companies": [("c1",), ("c2",)], "reports": [("r1", "c1", "VALIDATED"), ("r2", "c1", "VALIDATED"), ("r3", "c1", "VALIDATED"), ("r4", "c2", "PROVISIONAL")],
    "pairs": [("p1", "r1", "r2"), ("p2", "r2", "r3"), ("p3", "r1", "r3"), ("p4", "r3", "r4")],
    "segmentation_runs": [("s1", "r1", "COMPLETED", 1), ("s2", "r1", "COMPLETED_WITH_WARNINGS", 2), ("s3", "r1", "FAILED", 3), ("s4", "r4", "COMPLETED", 1)],
    "embedding_runs": [("e1", "s2", "COMPLETED", 1), ("e2", "s2", "COMPLETED", 2)],
    "feature_runs": [("f1", "p1", "a1", "COMPLETED", 1), ("f2", "p2", "a2", "COMPLETED", 1), ("f3", "p3", "a3", "FAILED", 1), ("f4", "p4", "a4", "COMPLETED", 1)],
    "language_runs": [("g1", "p1", "a1", "COMPLETED", 1), ("g2", "p2", "a0", "COMPLETED", 1)],
    "passages": [("x0", "s1", "old", None, "PARAGRAPH", False), ("x1", "s2", "rs", "rs", "HEADING_WITH_BODY", False), ("x2", "s2", "narrative", None, "PARAGRAPH", False), ("x4", "s4", "unseen", None, "PARAGRAPH", False)],
    "embeddings": [("x2", "e1", [1.0]), ("x2", "e2", [2.0])],
    "alignments": [("a1", True, 1), ("a1", False, 2), ("a2", True, 3), ("a3", True, 4)],
    "features": [("f1", "p1", 0.5), ("f2", "p2", 0.6), ("f3", "p3", 0.7), ("f4", "p4", 0.8)],
    "language": [("g1", "p1", 1.5), ("g2", "p2", 2.5)], "signals": [("g1", 7), ("g2", 8)],
}


def test_snapshot(spark):
    got = {k: v.collect() for k, v in snapshot({k: spark.createDataFrame(DATA[k], SCHEMAS[k]) for k in SCHEMAS}).items()}
    assert [r.company_id for r in got["companies"]] == ["c1"] and len(got["reports"]) == 3 and {r.pair_id for r in got["pairs"]} == {"p1", "p2", "p3"}
    assert {r.passage_id: (r.report_id, r.vector, r.category, r.artifact) for r in got["passages"]} == {"x1": ("r1", None, "short_fragment_invalid", True), "x2": ("r1", [2.0], None, False)}
    assert {r.pair_id: (r.score, r.tone, r.mismatch) for r in got["comparisons"]} == {"p1": (0.5, 1.5, False), "p2": (0.6, None, True)}
    assert sorted((r.pair_id, r.l_idx) for r in got["alignments"]) == [("p1", 1), ("p2", 3)]
    assert [(r.pair_id, r.hits) for r in got["signals"]] == [("p1", 7)]


def test_empty_snapshot(spark):
    assert all(not v.collect() for v in snapshot({k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}).values())
