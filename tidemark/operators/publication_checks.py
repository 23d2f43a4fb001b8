"""Every integrity check of a publication as one report; each table is read once for its row checks, joins are on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N

from .features import MATCHED
from .signals import ATTRIBUTION_LABELS, QUALITY_LABELS

#: Dimensions of a vector, share of passages that need one, content that isn't published (fixed values).
DIMENSIONS, EMBEDDED = 384, 0.95
UNPUBLISHED = ("short_fragment_invalid", "broken_fragment_sequence")
#: Discoveries that only comparisons fit for the primary analysis may enter (fixed values).
GATED = ("largest_overall_change", "largest_new_disclosure_share")

Rule = tuple[Column | None, Column]


def counted(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(check_name, checked, failures) of rules (applies, holds) in one pass; no applies is every row, a null holds fails."""
    aggregates, rows = [], []
    for name, (applies, holds) in rules.items():
        on = F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))
        aggregates += [F.count_if(on).alias(f"n_{name}"), F.count_if(on & ~F.coalesce(holds, F.lit(False))).alias(f"f_{name}")]
        rows.append(F.struct(F.lit(name).alias("check_name"), F.col(f"n_{name}").alias("checked"), F.col(f"f_{name}").alias("failures")))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _unique(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """One check: no two rows share a key; nulls are values."""
    groups = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return groups.agg(F.lit(name).alias("check_name"), F.lit(1).cast("long").alias("checked"), F.coalesce(F.max((F.col("_n") > 1).cast("long")), F.lit(0).cast("long")).alias("failures"))


def _contiguous(df: DataFrame, key: list[str], index: str, first: int) -> DataFrame:
    """A row for each key with `holds`: its indices are first, first + 1, ... without gap or repetition."""
    g = df.groupBy(*key).agg(F.min(index).alias("_a"), F.max(index).alias("_b"), F.count("*").alias("_n"), F.countDistinct(index).alias("_d"), F.count_if(F.col("latest")).alias("latest"))
    return g.withColumn("holds", (F.col("_a") == first) & (F.col("_b") == F.col("_n") + first - 1) & (F.col("_d") == F.col("_n")))


def _named(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The columns under a prefix, with a mark of the row's presence."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns], F.lit(True).alias(f"{prefix}_there"))


def _there(prefix: str) -> Column:
    return F.coalesce(F.col(f"{prefix}_there"), F.lit(False))


def _companies(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = t["companies"].join(t["reports"].select(F.col("company_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
    return [
        counted(c, {"company_has_report": (None, F.col("has"))}), _unique(t["companies"], ["source_company_id"], "no_duplicate_source_company_id"), _unique(t["reports"], ["source_report_id"], "no_duplicate_source_report_id"),
        _unique(t["comparisons"], ["source_report_pair_id"], "no_duplicate_source_pair_id"), _unique(t["passage_comparisons"], ["source_alignment_id"], "no_duplicate_source_alignment_id"),
    ]


def _comparisons(t: dict[str, DataFrame]) -> list[DataFrame]:
    c, reports = F.col, t["reports"]
    df = t["comparisons"].join(_named(reports, "er", "id", "company_id"), F.col("er_id") == F.col("earlier_report_id"), "left").join(_named(reports, "lr", "id", "company_id"), F.col("lr_id") == F.col("later_report_id"), "left")
    both = _there("er") & _there("lr")
    rules: dict[str, Rule] = {
        "comparison_reports_exist": (None, both), "comparison_same_company": (both, (c("er_company_id") == c("company_id")) & (c("lr_company_id") == c("company_id"))),
        "comparison_period_order": (c("earlier_period_end").isNotNull() & c("later_period_end").isNotNull(), c("earlier_period_end") < c("later_period_end")),
        "disclosure_change_quality_always_present": (None, c("disclosure_change_quality").isNotNull()),
        "disclosure_change_failed_quality_implies_no_displayed_score": (c("disclosure_change_quality") == "FAILED", c("disclosure_change_score").isNull()),
    }
    for layer, labels in (("report_side", QUALITY_LABELS), ("alignment_change", ATTRIBUTION_LABELS), ("disclosure_change", QUALITY_LABELS)):
        label, quality = c(f"{layer}_quality_label"), c(f"{layer}_quality")
        rules[f"{layer}_quality_label_in_vocabulary"] = (label.isNotNull(), label.isin(*labels.values()))
        rules[f"{layer}_primary_eligible_implies_ok_quality"] = (c(f"{layer}_primary_eligible") & quality.isNotNull(), quality.isin("GOOD", "USABLE"))
    order = _contiguous(t["comparisons"].withColumn("latest", F.coalesce("is_latest_for_company", F.lit(False))), ["company_id"], "chronological_index", 0)
    return [counted(df, rules), counted(order, {"chronological_index_contiguous": (None, c("holds")), "exactly_one_latest_per_company": (None, c("latest") == 1)})]


def _passages(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    shown = ~F.coalesce(c("structured_content_category").isin(*UNPUBLISHED), F.lit(False))
    e, w, status = c("earlier_passage_id"), c("later_passage_id"), c("alignment_status")
    return [
        counted(t["passages"], {"no_excluded_categories_published": (None, shown), "search_vectors_populated": (None, c("search_vector").isNotNull())}),
        counted(t["passage_comparisons"], {
            "passage_comparison_one_side_present": (None, e.isNotNull() | w.isNotNull()), "new_has_no_earlier_passage": (status == "NEW", e.isNull()),
            "removed_has_no_later_passage": (status == "REMOVED", w.isNull()), "matched_status_has_both_sides": (status.isin(*MATCHED), e.isNotNull() & w.isNotNull()),
        }),
    ]


def _discoveries(t: dict[str, DataFrame]) -> list[DataFrame]:
    c, items = F.col, t["discovery_items"]
    scope = F.when(c("rank_scope") == "company_history", c("company_id"))
    ranks = _contiguous(items.withColumn("_scope", scope).withColumn("latest", F.lit(False)), ["discovery_type", "rank_scope", "_scope"], "rank", 1)
    keys = items.select(c("supporting_metric_key").alias("metric_key")).distinct().join(t["metric_definitions"].select("metric_key", F.lit(True).alias("known")).distinct(), "metric_key", "left")
    gated = items.join(_named(t["comparisons"], "c", "id", "disclosure_change_primary_eligible"), c("c_id") == c("report_comparison_id"), "left")
    return [
        counted(ranks, {"discovery_rank_contiguous": (None, c("holds"))}), counted(keys, {"metric_definition_exists_for_discovery": (None, c("known"))}),
        counted(gated, {"feature_gated_discovery_excludes_non_primary_eligible": (c("discovery_type").isin(*GATED), c("c_disclosure_change_primary_eligible"))}),
    ]


def _vector_rules(prefix: str) -> dict[str, Rule]:
    dims = (F.col("dimensions") == DIMENSIONS) & (F.size("embedding") == DIMENSIONS)
    return {f"{prefix}_dimensions_match_configured_column": (None, dims), f"{prefix}_vector_not_zero": (None, N.norm(F.col("embedding")) > 1e-9)}


def _embeddings(t: dict[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    e = t["embeddings"].join(_named(t["passages"], "p", "id", "text"), c("p_id") == c("passage_id"), "left")
    rules: dict[str, Rule] = {
        "passage_embedding_references_published_passage": (None, _there("p")), **_vector_rules("passage_embedding"),
        "passage_embedding_text_hash_self_consistent": (_there("p"), c("embedding_text_hash") == F.sha2(c("p_text"), 256)),
    }
    has = t["passages"].join(t["embeddings"].select(c("passage_id").alias("id"), F.lit(True).alias("has")).distinct(), "id", "left")
    share = has.agg(F.count("*").alias("n"), F.count("has").alias("k"))
    enough = (c("n") == 0) | (c("k") / c("n") >= EMBEDDED)
    return [_unique(t["embeddings"], ["passage_id", "embedding_model", "embedding_model_revision"], "no_duplicate_passage_embeddings"), counted(share, {"embedding_coverage_meets_minimum": (None, enough)}), counted(e, rules)]


def _contexts(t: dict[str, DataFrame]) -> list[DataFrame]:
    c, contexts = F.col, t["contexts"]
    last = t["embeddings"].groupBy("passage_id").agg(F.collect_set("id").alias("ids"))
    df = contexts.join(_named(t["passages"], "p", "id"), c("p_id") == c("passage_id"), "left").join(last.select(c("passage_id").alias("e_passage"), "ids"), c("e_passage") == c("passage_id"), "left")
    df = df.join(_named(t["passage_comparisons"], "pc", "id", "earlier_passage_id", "later_passage_id", "alignment_status"), c("pc_id") == c("passage_comparison_id"), "left")
    df = df.join(_named(t["comparisons"], "c", "id", "report_side_quality", "alignment_change_quality", "is_irregular_gap"), c("c_id") == c("report_comparison_id"), "left")
    alone = c("context_type") == "REPORT_ONLY"
    linked = ~F.coalesce(alone, F.lit(False))
    found = linked & _there("pc")
    own = F.when(c("report_side") == "EARLIER", c("pc_earlier_passage_id")).otherwise(c("pc_later_passage_id"))
    same = reduce(Column.__and__, [c(a).eqNullSafe(c(b)) for a, b in (("report_side_quality", "c_report_side_quality"), ("alignment_change_quality", "c_alignment_change_quality"), ("irregular_gap_flag", "c_is_irregular_gap"))])
    rules: dict[str, Rule] = {
        "retrieval_context_references_published_passage": (None, _there("p")), "retrieval_context_references_published_embedding": (None, F.array_contains("ids", c("passage_embedding_id"))),
        "report_only_context_has_no_comparison_fields": (alone, c("passage_comparison_id").isNull() & c("report_comparison_id").isNull() & c("report_side").isNull()),
        "comparison_linked_context_has_report_side": (linked, c("report_side").isin("EARLIER", "LATER")), "comparison_linked_context_references_published_passage_comparison": (linked, _there("pc")),
        "retrieval_context_side_matches_passage_comparison_side": (found, c("passage_id") == own), "new_context_is_later_side": (found & (c("pc_alignment_status") == "NEW"), c("report_side") == "LATER"),
        "removed_context_is_earlier_side": (found & (c("pc_alignment_status") == "REMOVED"), c("report_side") == "EARLIER"), "retrieval_context_quality_matches_parent_comparison": (found, _there("c") & same),
    }
    return [_unique(contexts, ["passage_id", "passage_comparison_id", "report_side", "context_type"], "no_duplicate_retrieval_contexts"), counted(df, rules), *_tags(t)]


def _tags(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Whether the tags of a context are those that its passage's signals say, category by category and risk by risk."""
    c, out = F.col, []
    scope = ["passage_comparison_id", "report_side"]
    positive = t["signals"].where("adjusted_count > 0")
    risks = positive.where("category = 'risk' and subcategory is not null")
    linked = t["contexts"].where("context_type = 'COMPARISON_LINKED'").select("id", *scope)
    for table, value, said, reference, name in (
        ("context_categories", "category", positive, "retrieval_context_category_references_published_context", "retrieval_context_language_categories_match_passage_language_signals"),
        ("context_risks", "subcategory", risks, "retrieval_context_risk_subcategory_references_published_context", "retrieval_context_risk_subcategories_match_passage_language_signals"),
    ):
        tags = t[table]
        out.append(counted(tags.join(_named(t["contexts"], "x", "id"), c("x_id") == c("retrieval_context_id"), "left"), {reference: (None, _there("x"))}))
        have = tags.select(c("retrieval_context_id").alias("id"), c(value).alias("_v"), F.lit(1).alias("_have")).distinct().join(linked.select("id"), "id", "left_semi")
        on = reduce(Column.__and__, [c(f"l.{k}").eqNullSafe(c(f"s.{k}")) for k in scope])
        want = linked.alias("l").join(said.select(*scope, c(value).alias("_v")).distinct().alias("s"), on).select("id", "_v", F.lit(1).alias("_want"))
        wrong = have.join(want, ["id", "_v"], "full_outer").where("_have is null or _want is null").select("id").distinct().withColumn("wrong", F.lit(True))
        out.append(counted(linked.join(wrong, "id", "left"), {name: (None, c("wrong").isNull())}))
    return out


def _chunks(t: dict[str, DataFrame]) -> list[DataFrame]:
    c, chunks = F.col, t["qa_chunks"]
    members = t["qa_chunk_passages"]
    df = chunks.join(_named(t["reports"], "r", "id", "company_id"), c("r_id") == c("report_id"), "left").join(members.select(c("qa_chunk_id").alias("id"), F.lit(True).alias("member")).distinct(), "id", "left")
    rules: dict[str, Rule] = {
        "qa_chunk_references_published_report": (None, _there("r")), "qa_chunk_company_matches_report_company": (_there("r"), c("company_id") == c("r_company_id")), "qa_chunk_page_range_valid": (None, c("page_start") <= c("page_end")),
        **_vector_rules("qa_chunk"), "qa_chunk_embedding_text_hash_self_consistent": (None, c("embedding_text_hash") == F.sha2("text", 256)), "qa_chunk_has_complete_source_lineage": (None, c("member")),
    }
    hashes = chunks.groupBy("report_id", "embedding_text_hash").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked"), F.coalesce(F.sum(c("n") - 1), F.lit(0)).cast("long").alias("failures"))
    m = members.join(_named(chunks, "k", "id", "report_id"), c("k_id") == c("qa_chunk_id"), "left").join(_named(t["passages"], "p", "id", "report_id"), c("p_id") == c("passage_id"), "left")
    return [
        _unique(chunks, ["report_id", "chunk_index"], "no_duplicate_qa_chunk_index"), counted(df, rules), hashes.select(F.lit("no_duplicate_qa_chunk_text_hash_within_report").alias("check_name"), "checked", "failures"),
        counted(m, {
            "qa_chunk_passage_references_published_chunk": (None, _there("k")), "qa_chunk_passage_references_published_passage": (None, _there("p")), "qa_chunk_passage_same_report": (_there("k") & _there("p"), c("k_report_id") == c("p_report_id")),
        }),
    ]


def publication_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, checked, failures) of every check over the tables of one publication.

    tables: companies, reports, comparisons, passages, passage_comparisons, discovery_items, metric_definitions, embeddings,
    contexts, signals, context_categories, context_risks, qa_chunks, qa_chunk_passages. A publication may be activated if no
    check fails. A check that nothing calls for has 0 checked. Empty tables fail nothing.
    """
    parts = [d for part in (_companies, _comparisons, _passages, _discoveries, _embeddings, _contexts, _chunks) for d in part(tables)]
    return reduce(DataFrame.unionByName, parts)
