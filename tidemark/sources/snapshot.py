"""What a publication is built from: of every table the rows of the current runs, as lazy frames over one set of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.publication_checks import UNPUBLISHED
from tidemark.operators.serving import of_same_lineage
from tidemark.operators.structure import structured_category
from tidemark.operators.windows import current_runs


def _current(runs: DataFrame, key: str, *inputs: str) -> DataFrame:
    """(key, run_id, inputs): the newest completed run of each key."""
    return current_runs(runs, [key], "status", "completed_at", "run_id").select(key, "run_id", *inputs)


def snapshot(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """companies, reports, pairs, passages, comparisons, alignments, signals: all that is accepted and current.

    tables: companies (company_id), reports (report_id, company_id, metadata_status), pairs (pair_id, earlier_report_id,
    later_report_id), segmentation_runs (run_id, report_id), embedding_runs (run_id, segmentation_run_id), feature_runs
    (run_id, pair_id, alignment_run_id), language_runs (run_id, pair_id, alignment_run_id), each run with status and
    completed_at; passages (passage_id, run_id, text, heading, passage_type, list_item), embeddings (passage_id, run_id,
    vector), alignments (alignment_run_id, primary_alignment, ...), features and language (run_id, ...), signals (run_id, ...).

    Only validated reports count, and companies and pairs of these. A pair without a current feature run or its features is
    left out; alignments are the primary ones of the run that its features used. Language results of another alignment run
    are left out and `mismatch` says so. Passages are those of a report's current segmentation, with the vector of its
    current embedding run or null, their kind of structured content, and `artifact` where that isn't published.
    """
    c = F.col
    reports = tables["reports"].where("metadata_status = 'VALIDATED'")
    companies = tables["companies"].join(reports.select("company_id"), "company_id", "left_semi")
    ids = reports.select("report_id")
    pairs = tables["pairs"].join(ids.withColumnRenamed("report_id", "earlier_report_id"), "earlier_report_id", "left_semi").join(ids.withColumnRenamed("report_id", "later_report_id"), "later_report_id", "left_semi")

    segmented = _current(tables["segmentation_runs"], "report_id").join(ids, "report_id", "left_semi")
    embedded = _current(tables["embedding_runs"], "segmentation_run_id").select(c("segmentation_run_id").alias("run_id"), c("run_id").alias("embedding_run_id"))
    vectors = tables["embeddings"].select("passage_id", c("run_id").alias("embedding_run_id"), "vector")
    passages = tables["passages"].join(segmented, "run_id").join(embedded, "run_id", "left").join(vectors, ["passage_id", "embedding_run_id"], "left")
    category = structured_category(c("text"), c("heading"), c("passage_type"), c("list_item"))
    passages = passages.withColumn("category", category).withColumn("artifact", F.coalesce(c("category").isin(*UNPUBLISHED), F.lit(False)))

    runs = _current(tables["feature_runs"], "pair_id", "alignment_run_id").where("alignment_run_id is not null")
    features = pairs.join(runs.withColumnRenamed("run_id", "feature_run_id"), "pair_id").join(tables["features"].withColumnRenamed("run_id", "feature_run_id"), ["pair_id", "feature_run_id"])
    language = _current(tables["language_runs"], "pair_id", "alignment_run_id").withColumnRenamed("run_id", "language_run_id")
    comparisons = of_same_lineage(features, language, "pair_id", "alignment_run_id", ["language_run_id"])
    payload = tables["language"].withColumnRenamed("run_id", "language_run_id")
    comparisons = comparisons.join(payload, ["pair_id", "language_run_id"], "left")
    used = comparisons.select("pair_id", "alignment_run_id")
    alignments = tables["alignments"].where("primary_alignment").join(used, "alignment_run_id")
    told = comparisons.join(payload.select("language_run_id", "pair_id"), ["pair_id", "language_run_id"], "left_semi").select("pair_id", c("language_run_id").alias("run_id"))
    signals = tables["signals"].join(told, "run_id")
    return {"companies": companies, "reports": reports, "pairs": pairs, "passages": passages, "comparisons": comparisons, "alignments": alignments, "signals": signals}
