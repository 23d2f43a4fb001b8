"""Queries of the full builds: change features and language features of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import language_build as G
from tidemark.operators import pair_build as B
from tidemark.operators.features import WEIGHTS

from .registry import query
from .relational_queries import t

STATUSES = list(WEIGHTS)
#: Lines of a supplier as passages on both sides; their statuses by number, two in fifteen without one side.
INPUT_SQL = """x AS (SELECT l_suppkey AS pair, (l_quantity * 4)::BIGINT AS ew, (l_quantity * 3)::BIGINT AS lw, CASE WHEN l_linenumber % 3 = 0 THEN 'HEADING_WITH_BODY' ELSE 'PARAGRAPH' END AS et, CASE WHEN l_linenumber % 4 = 0 THEN 'HEADING_WITH_BODY' ELSE 'PARAGRAPH' END AS lt,
  (l_orderkey + l_linenumber) % 15 AS k, CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'LOW' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM lineitem),
a AS (SELECT pair, CASE WHEN k = 13 THEN 'NEW' WHEN k = 14 THEN 'REMOVED' WHEN k = 12 THEN 'AMBIGUOUS' WHEN k < 5 THEN 'UNCHANGED' WHEN k < 9 THEN 'LIGHTLY_MODIFIED' ELSE 'SUBSTANTIALLY_MODIFIED' END AS status, confidence,
  CASE WHEN k <> 13 THEN ew END AS e, CASE WHEN k NOT IN (12, 14) THEN lw END AS l, CASE WHEN k <> 13 THEN et END AS et, CASE WHEN k NOT IN (12, 14) THEN lt END AS lt FROM x),
b AS (SELECT *, CASE WHEN status = 'NEW' THEN l WHEN status = 'REMOVED' THEN e WHEN status = 'AMBIGUOUS' THEN coalesce(e, l) ELSE (e + l) / 2.0 END::DOUBLE AS w,
  CASE WHEN coalesce(e < 40, false) OR coalesce(l < 40, false) THEN CASE WHEN (coalesce(e < 40, false) AND et <> 'HEADING_WITH_BODY') OR (coalesce(l < 40, false) AND lt <> 'HEADING_WITH_BODY') THEN 'low_information' ELSE 'heading_fragment' END END AS why FROM a),
p AS (SELECT s_suppkey AS pair, (s_suppkey % 17 + 3)::INTEGER AS gap_months, s_suppkey % 7 = 0 AS is_transition, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 10) / 10.0 END::DOUBLE AS cosine, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 9) / 9.0 END::DOUBLE AS bigram_jaccard, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS edit, NULL::DOUBLE AS diff,
  ((s_suppkey % 5) - 2)::DOUBLE / 4 AS word_change_ratio, CASE WHEN s_suppkey % 19 = 0 THEN 'FAILED' WHEN s_suppkey % 6 = 0 THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS document_quality, CASE WHEN s_suppkey % 3 = 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS run_status, CASE WHEN s_suppkey % 9 = 0 THEN '2 ambiguous alignment(s)' END AS run_review_reason,
  90::BIGINT AS embedded_earlier, (s_suppkey % 30)::BIGINT AS skipped_earlier, (s_suppkey % 12) * 9 AS embedded_later, 9::BIGINT AS skipped_later FROM supplier)"""


def _sql() -> str:
    low = [(s, s.lower()) for s in STATUSES]
    sums = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}_count, coalesce(sum(w) FILTER (status = '{s}'), 0) AS {n}_words, count(*) FILTER (status = '{s}' AND why IS NULL) AS eligible_{n}_count, coalesce(sum(w) FILTER (status = '{s}' AND why IS NULL), 0) AS eligible_{n}_words" for s, n in low)
    sides = ", ".join(f"count(*) AS {x}_passage_count, sum({c}w)::BIGINT AS {x}_word_count, count(*) FILTER ({c}w >= 40) AS eligible_{x}_passage_count, count(*) FILTER ({c}w < 40 AND {c}t = 'HEADING_WITH_BODY') AS {c}f" for x, c in (("earlier", "e"), ("later", "l")))
    confidence = ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c.lower()}_confidence_count" for c in B.CONFIDENCE)
    every = lambda kind: " + ".join(f"eligible_{n}_{kind}" for _, n in low)
    rates = ", ".join(f"eligible_{n}_{kind} / nullif({every(kind)}, 0) AS {n}_rate_{kind}" for _, n in low for kind in ("count", "words"))
    parts = ", ".join(f"{n}_rate_words * {w} AS score_{n}_component" for (s, n), w in zip(low, WEIGHTS.values(), strict=True))
    score = " + ".join(f"score_{n}_component" for _, n in low)
    four = "list_filter([cosine, bigram_jaccard, edit, diff], lambda v: v IS NOT NULL)"
    note = lambda c, label, op, bar, tail: f"CASE WHEN {c} {op} {bar} THEN '{label} ' || printf('%.2f', {c} + 1e-9) || '{tail}' END"
    review = ", ".join(
        [
            "CASE WHEN document_quality = 'NEEDS_REVIEW' THEN 'document-level similarity quality is NEEDS_REVIEW' END", "CASE WHEN irregular_gap AND NOT is_transition THEN 'irregular reporting gap: unexplained, not a flagged transition period' END",
            *[note(c, label, "<", 0.8, " below threshold (0.8)") for c, label in (("alignment_coverage_count", "alignment coverage (count)"), ("alignment_coverage_words", "alignment coverage (words)"), ("embedded_coverage_earlier", "earlier embedding coverage"), ("embedded_coverage_later", "later embedding coverage"))],
            note("ambiguous_rate_words", "ambiguous word share", ">", 0.15, " exceeds tolerance (0.15)"), note("review_required_share", "low/needs-review confidence share", ">", 0.25, " exceeds tolerance (0.25)"),
        ]
    )
    return f"""WITH {INPUT_SQL}, s AS (SELECT pair, {sides} FROM x GROUP BY 1),
    g AS (SELECT pair, count(*) AS aligned_passage_count, count(*) FILTER (why IS NULL) AS eligible_aligned_passage_count, {sums}, {confidence}, count(*) FILTER (why IS NOT NULL) AS excluded_low_information_count, coalesce(sum(w) FILTER (why IS NOT NULL), 0) AS excluded_low_information_words,
      count(*) FILTER (why = 'heading_fragment') AS excluded_heading_fragment_count, coalesce(sum(w) FILTER (why = 'heading_fragment'), 0) AS excluded_heading_fragment_words, count(e) + count(l) AS both_sides, sum(coalesce(e, 0) + coalesce(l, 0)) AS both_words FROM b GROUP BY 1),
    j AS (SELECT * FROM p JOIN s USING (pair) JOIN g USING (pair)),
    r AS (SELECT *, {rates}, both_sides / (earlier_passage_count + later_passage_count) AS alignment_coverage_count, both_words / (earlier_word_count + later_word_count) AS alignment_coverage_words, embedded_earlier / nullif(embedded_earlier + skipped_earlier, 0) AS embedded_coverage_earlier, embedded_later / nullif(embedded_later + skipped_later, 0) AS embedded_coverage_later,
      ef / earlier_passage_count AS heading_fragment_share_earlier, lf / later_passage_count AS heading_fragment_share_later, high_confidence_count / aligned_passage_count AS high_confidence_share, (low_confidence_count + needs_review_confidence_count) / aligned_passage_count AS review_required_share, NOT gap_months BETWEEN 9 AND 15 AS irregular_gap,
      1 - cosine AS cosine_change, 1 - bigram_jaccard AS bigram_jaccard_change, 1 - edit AS edit_change, 1 - diff AS diff_change, abs(word_change_ratio) AS word_change_ratio_abs, CASE WHEN len({four}) >= 2 THEN list_max({four}) - list_min({four}) END AS metric_disagreement_spread FROM j),
    c AS (SELECT *, {parts} FROM r),
    d AS (SELECT *, CASE WHEN alignment_coverage_words >= 0.8 AND embedded_coverage_earlier >= 0.8 AND embedded_coverage_later >= 0.8 AND {score} IS NOT NULL THEN greatest(0.0, least(1.0, {score})) END AS disclosure_change_score, nullif(concat_ws('; ', {review}), '') AS review FROM c),
    q AS (SELECT *, CASE WHEN document_quality = 'FAILED' THEN 'FAILED' WHEN review IS NOT NULL THEN 'NEEDS_REVIEW' WHEN run_status = 'COMPLETED_WITH_WARNINGS' THEN 'USABLE' ELSE 'GOOD' END AS feature_quality FROM d)
    SELECT * EXCLUDE (ef, lf, both_sides, both_words, review), CASE WHEN feature_quality = 'FAILED' THEN 'document-level similarity quality is FAILED' ELSE nullif(concat_ws('; ', review, CASE WHEN run_status = 'COMPLETED_WITH_WARNINGS' THEN 'alignment run completed with warnings: ' || coalesce(run_review_reason, 'unspecified') END, CASE WHEN irregular_gap AND is_transition THEN 'irregular gap on an approved transition-period pair' END), '') END AS warning_reasons,
      feature_quality IN ('GOOD', 'USABLE') AND NOT is_transition AND NOT irregular_gap AND disclosure_change_score IS NOT NULL AS primary_eligible,
      CASE WHEN feature_quality = 'FAILED' THEN 'document-level similarity quality is FAILED' ELSE nullif(concat_ws('; ', CASE WHEN feature_quality = 'NEEDS_REVIEW' THEN 'feature quality is NEEDS_REVIEW' END, CASE WHEN is_transition THEN 'transition-period pair excluded from primary analysis by default' END, CASE WHEN irregular_gap THEN 'irregular reporting gap excluded from primary analysis by default' END,
        CASE WHEN disclosure_change_score IS NULL THEN 'disclosure_change_score unavailable (insufficient coverage or quality)' END), '') END AS exclusion_reasons, CASE WHEN feature_quality = 'GOOD' THEN 'COMPLETED' ELSE 'COMPLETED_WITH_WARNINGS' END AS feature_run_status FROM q"""


def _rounded_sql() -> str:
    """The build's rows with doubles rounded, as the query rounds them."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in DOUBLES)}) FROM ({_sql()})"


DOUBLES = [f"{s.lower()}_rate_{kind}" for s in STATUSES for kind in ("count", "words")] + [f"score_{s.lower()}_component" for s in STATUSES] + [
    "cosine", "bigram_jaccard", "cosine_change", "bigram_jaccard_change", "metric_disagreement_spread", "alignment_coverage_count", "alignment_coverage_words", "embedded_coverage_earlier", "embedded_coverage_later",
    "heading_fragment_share_earlier", "heading_fragment_share_later", "high_confidence_share", "review_required_share", "disclosure_change_score",
]


@query("pair_feature_build", _rounded_sql())
def pair_feature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All change features of every supplier as a pair, its lines being the passages of both sides."""
    li = t(spark, sf_dir, "lineitem")
    k, n = (F.col("l_orderkey") + F.col("l_linenumber")) % 15, F.col("l_linenumber")
    kind = lambda m: F.when(n % m == 0, F.lit("HEADING_WITH_BODY")).otherwise(F.lit("PARAGRAPH"))
    sides = {"earlier": ((F.col("l_quantity") * 4).cast("long"), kind(3), k != 13), "later": ((F.col("l_quantity") * 3).cast("long"), kind(4), ~k.isin(12, 14))}
    structs = [F.struct(F.lit(x).alias("side"), w.alias("words"), ty.alias("type")) for x, (w, ty, _) in sides.items()]
    passages = li.select(F.col("l_suppkey").alias("pair"), F.explode(F.array(*structs)).alias("s")).select("pair", "s.*")
    status = F.when(k == 13, "NEW").when(k == 14, "REMOVED").when(k == 12, "AMBIGUOUS").when(k < 5, "UNCHANGED").when(k < 9, "LIGHTLY_MODIFIED").otherwise("SUBSTANTIALLY_MODIFIED")
    c = (F.col("l_orderkey") + n) % 11
    confidence = F.when(c == 0, "LOW").when(c == 1, "NEEDS_REVIEW").when(c == 2, "MEDIUM").otherwise("HIGH")
    rows = li.select(F.col("l_suppkey").alias("pair"), status.alias("status"), confidence.alias("confidence"), *[F.when(there, v).alias(f"{x}_{name}") for x, (w, ty, there) in sides.items() for name, v in (("words", w), ("type", ty))])
    s = F.col("s_suppkey")
    of = lambda c, x: F.when(c, F.lit(x))
    pairs = t(spark, sf_dir, "supplier").select(
        s.alias("pair"), (s % 17 + 3).cast("int").alias("gap_months"), (s % 7 == 0).alias("is_transition"), F.when(s % 5 != 0, s % 10 / 10.0).alias("cosine"), F.when(s % 5 != 0, s % 9 / 9.0).alias("bigram_jaccard"), F.when(s % 4 != 0, F.lit(0.5)).alias("edit"), F.lit(None).cast("double").alias("diff"),
        ((s % 5 - 2) / 4).cast("double").alias("word_change_ratio"), of(s % 19 == 0, "FAILED").when(s % 6 == 0, "NEEDS_REVIEW").otherwise("GOOD").alias("document_quality"), of(s % 3 == 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED").alias("run_status"), of(s % 9 == 0, "2 ambiguous alignment(s)").alias("run_review_reason"),
        F.lit(90).cast("long").alias("embedded_earlier"), (s % 30).cast("long").alias("skipped_earlier"), (s % 12 * 9).cast("long").alias("embedded_later"), F.lit(9).cast("long").alias("skipped_later"),
    )
    out = B.pair_features(pairs, passages, rows, "pair").join(rows.select("pair").distinct(), "pair", "left_semi")
    return out.withColumns({name: F.round(name, 6) for name in DOUBLES})


HITS = (*G.CORE, *G.CUSTOM)
#: Lines of a supplier as signal rows.
SIGNALS_SQL = f"""x AS (SELECT l_suppkey AS pair, CASE WHEN l_linenumber % 2 = 0 THEN 'EARLIER' ELSE 'LATER' END AS side, CASE WHEN l_orderkey % 15 = 13 THEN 'NEW' WHEN l_orderkey % 15 = 14 THEN 'REMOVED' WHEN l_orderkey % 15 = 12 THEN 'AMBIGUOUS' WHEN l_orderkey % 15 < 6 THEN 'UNCHANGED' ELSE 'SUBSTANTIALLY_MODIFIED' END AS status,
  CASE l_partkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, (l_quantity * 4)::BIGINT AS words, CASE (l_orderkey + l_linenumber) % 13 WHEN 0 THEN 'list_content' WHEN 1 THEN 'table_context' WHEN 2 THEN 'currency_exposure_table_mixed' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'caption_or_label_like' WHEN 5 THEN 'numeric_or_table_like_source' END AS category,
  l_quantity >= 10 AS eligible, l_partkey % 4 < l_suppkey % 5 AS collision, CASE WHEN l_suppkey % 4 = 0 THEN l_orderkey % 2 ELSE l_orderkey % 12 END AS total_hits, {", ".join(f"(l_orderkey * {i + 1} + l_partkey) % 4 AS {x}" for i, x in enumerate(HITS))} FROM lineitem),
r AS (SELECT *, (category IS NULL OR category NOT IN ({", ".join(f"'{x}'" for x in G.EXCLUDED)})) AS prim FROM x), o AS (SELECT * FROM r WHERE prim AND eligible),
p AS (SELECT s_suppkey AS pair, s_suppkey % 7 = 0 AS is_transition, s_suppkey % 3 = 0 AS irregular_gap, CASE WHEN s_suppkey % 8 = 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS run_status, CASE WHEN s_suppkey % 16 = 0 THEN 'one; two' END AS run_review_reason, CASE WHEN s_suppkey % 19 = 0 THEN 'FAILED' WHEN s_suppkey % 10 = 1 THEN 'NEEDS_REVIEW' ELSE 'GOOD' END AS feature_quality FROM supplier)"""


def _language_sql() -> str:
    two = ("earlier", "later")
    w = lambda cond: f"coalesce(sum(words) FILTER ({cond}), 0)::BIGINT"
    on = {s: f"side = '{s.upper()}'" for s in two}
    everything = [f"count(*) FILTER ({on[s]}) AS all_passages_{s}_count, {w(on[s])} AS all_passages_{s}_words, count(*) FILTER (prim AND {on[s]}) AS primary_narrative_{s}_count, {w(f'prim AND {on[s]}')} AS primary_narrative_{s}_words" for s in two]
    everything += [f"count(*) FILTER ({c}) AS {n}_count, {w(c)} AS {n}_words" for n, c in (("excluded_structured_content", "NOT prim"), *((n, f"coalesce(category = '{k}', false)") for n, k in G.KINDS.items()))]
    ok = [f"{w(on[s])} AS w_{s}, coalesce(sum(total_hits) FILTER ({on[s]}), 0)::BIGINT AS h_{s}" for s in two] + [f"{w(f'category IS DISTINCT FROM {chr(39)}{k}{chr(39)}')} AS primary_narrative_words_excluding_{n}" for n, k in G.WITHOUT.items()]
    ok += [f"coalesce(sum({x}) FILTER ({on[s]}), 0)::BIGINT AS {x}_count_{s}" for x in HITS for s in two] + [f"coalesce(sum({x}) FILTER (status = '{s.upper()}'), 0)::BIGINT AS {x}_hits_{s}" for x in (*G.CORE, "risk") for s in ("new", "removed", "ambiguous")]
    ok += [f"{w(f'status = {chr(39)}{s.upper()}{chr(39)}')} AS w_{s}" for s in ("new", "removed", "ambiguous")]
    ok += [f"1000 * sum({x}) FILTER (status = 'SUBSTANTIALLY_MODIFIED' AND side = 'LATER') / sum(words) FILTER (status = 'SUBSTANTIALLY_MODIFIED' AND side = 'LATER') - 1000 * sum({x}) FILTER (status = 'SUBSTANTIALLY_MODIFIED' AND side = 'EARLIER') / sum(words) FILTER (status = 'SUBSTANTIALLY_MODIFIED' AND side = 'EARLIER') AS substantially_modified_{x}_rate_change" for x in ("positive", "negative", "uncertainty")]
    ok += ["coalesce(sum(total_hits) FILTER (confidence = 'HIGH'), 0)::BIGINT AS high_confidence_dictionary_hits", "coalesce(sum(total_hits) FILTER (confidence IN ('HIGH', 'MEDIUM')), 0)::BIGINT AS high_and_medium_confidence_dictionary_hits", "coalesce(sum(total_hits), 0)::BIGINT AS h", f"{w('collision')} AS wc"]
    ok += [f"{w(c)} AS alignment_change_analyzed_words_{n}" for n, c in (("all", "true"), ("excl_ambiguous", "status <> 'AMBIGUOUS'"), ("hml", "confidence <> 'NEEDS_REVIEW'"), ("hm", "confidence IN ('HIGH', 'MEDIUM')"), ("h", "confidence = 'HIGH'"))]
    rates = [f"1000.0 * {x}_count_{s} / nullif(w_{s}, 0) AS {x}_rate_{s}" for x in HITS for s in two] + [f"1000.0 * {x}_hits_{s} / nullif(w_{s}, 0) AS {x}_language_{n}" for x in ("negative", "positive", "risk") for n, s in (("introduction", "new"), ("removal", "removed"))]
    t1, both = "alignment_change_analyzed_words_all", "nullif(all_passages_earlier_words + all_passages_later_words, 0)"
    rates += [f"h_{s} / nullif(w_{s}, 0) AS dictionary_match_rate_{s}, primary_narrative_{s}_words / nullif(all_passages_{s}_words, 0) AS nar_{s}" for s in two]
    rates += [f"({both} / {both})::DOUBLE AS analyzed_word_coverage, (primary_narrative_earlier_words + primary_narrative_later_words) / {both} AS primary_narrative_coverage, h / nullif({t1}, 0) AS dictionary_match_rate, list_content_words / greatest({t1}, 1) AS list_content_share, uncertain_words / greatest({t1}, 1) AS uncertain_content_share"]
    rates += [f"w_ambiguous / nullif({t1}, 0) AS ambiguous_alignment_share, wc / nullif({t1}, 0) AS collision_flagged_word_share, (w_new + w_removed) / nullif({t1}, 0) AS unmatched_word_share, w_ambiguous AS ambiguous_words_in_report_side"]
    changes = [f"{x}_rate_later - {x}_rate_earlier AS {x}_rate_change, abs({x}_rate_later - {x}_rate_earlier) AS {x}_rate_change_abs" for x in G.CORE] + [f"positive_rate_{s} - negative_rate_{s} AS net_tone_{s}" for s in two]
    changes += ["(positive_rate_later - negative_rate_later) - (positive_rate_earlier - negative_rate_earlier) AS net_tone_change, uncertainty_rate_later - uncertainty_rate_earlier AS uncertainty_intensity_change, uncertainty_rate_later + weak_modal_rate_later - uncertainty_rate_earlier - weak_modal_rate_earlier AS forward_looking_caution_change", *[f"{x}_rate_later - {x}_rate_earlier AS {x}_language_change" for x in ("governance", "financial_condition")]]
    say = lambda cond, label, c, d, tail: f"CASE WHEN {cond} THEN '{label} ' || printf('%.{d}f', {c} + 1e-9) || ' {tail}' END"
    gap = "CASE WHEN irregular_gap AND NOT is_transition THEN 'irregular reporting gap: unexplained, not a flagged transition period' END"
    side_review = ", ".join([gap, *[say(f"nar_{s} < 0.7", f"{s} primary-narrative word coverage", f"nar_{s}", 2, "below threshold (0.7)") for s in two], *[say(f"dictionary_match_rate_{s} < 0.02", f"{s} dictionary match rate", f"dictionary_match_rate_{s}", 3, "is anomalously low (< 0.02)") for s in two]])
    side_info = ", ".join(say(f"dictionary_match_rate_{s} >= 0.02 AND dictionary_match_rate_{s} < 0.05", f"{s} dictionary match rate", f"dictionary_match_rate_{s}", 3, "is borderline (< 0.05) -- plausible but worth spot-checking") for s in two)
    share = "collision_flagged_word_share"
    change_review = ", ".join([gap, say("ambiguous_alignment_share > 0.15", "ambiguous word share", "ambiguous_alignment_share", 2, "exceeds tolerance (0.15) -- genuine non-correspondence, not just non-uniqueness"), say(f"{share} > 0.85", "collision-flagged word share", share, 2, "exceeds tolerance (0.85)")])
    change_info = ", ".join(["CASE WHEN run_status = 'COMPLETED_WITH_WARNINGS' THEN 'alignment run completed with warnings: ' || coalesce(run_review_reason, 'unspecified') END", "CASE WHEN feature_quality = 'NEEDS_REVIEW' THEN 'upstream feature quality is NEEDS_REVIEW' END",
        say(f"{share} > 0.6 AND {share} <= 0.85", "collision-flagged word share", share, 2, "above 0.6 -- non-unique correspondence (duplicate/boilerplate content), not a demonstrated mismatch"), say("unmatched_word_share > 0.4", "unmatched word share", "unmatched_word_share", 2, "above 0.4 -- high content turnover, not necessarily a defect")])
    context = "CASE WHEN irregular_gap AND is_transition THEN 'irregular gap on an approved transition-period pair' END"
    why = lambda n, label: f"nullif(concat_ws('; ', CASE WHEN {n}_signal_quality NOT IN ('GOOD', 'USABLE') THEN '{label} quality is ' || {n}_signal_quality END, CASE WHEN is_transition THEN '{G.TRANSITION}' END, CASE WHEN irregular_gap THEN '{G.IRREGULAR}' END), '')"
    prefixed = lambda x: "nullif(concat_ws('; ', " + ", ".join(f"'[{label}] ' || replace({n}_{x}_reasons, '; ', '; [{label}] ')" for n, label in (("report_side", "report-side"), ("alignment_change", "alignment-change"))) + f"), '') AS {x}_reasons"
    lost = ", ".join(["w_earlier, w_later, h_earlier, h_later, h, wc, w_new, w_removed, w_ambiguous, nar_earlier, nar_later, sr, si, cr, ci", *[f"risk_hits_{s}" for s in ("new", "removed", "ambiguous")], *[f"{x}_count_{s}" for x in G.CUSTOM for s in two]])
    failed = "'upstream feature quality is FAILED'"
    return f"""WITH {SIGNALS_SQL}, a AS (SELECT pair, {", ".join(everything)} FROM r GROUP BY 1), b AS (SELECT pair, {", ".join(ok)} FROM o GROUP BY 1), j AS (SELECT * FROM p JOIN a USING (pair) JOIN b USING (pair)),
    s AS (SELECT *, {", ".join(rates)} FROM j), c AS (SELECT *, {", ".join(changes)}, nullif(concat_ws('; ', {side_review}), '') AS sr, nullif(concat_ws('; ', {side_info}), '') AS si, nullif(concat_ws('; ', {change_review}), '') AS cr, nullif(concat_ws('; ', {change_info}), '') AS ci FROM s),
    d AS (SELECT *, CASE WHEN sr IS NOT NULL THEN 'NEEDS_REVIEW' WHEN si IS NOT NULL THEN 'USABLE' ELSE 'GOOD' END AS report_side_signal_quality, CASE WHEN feature_quality = 'FAILED' THEN 'FAILED' WHEN cr IS NOT NULL THEN 'NEEDS_REVIEW' WHEN ci IS NOT NULL THEN 'USABLE' ELSE 'GOOD' END AS alignment_change_signal_quality FROM c),
    e AS (SELECT *, nullif(concat_ws('; ', sr, si, {context}), '') AS report_side_warning_reasons, CASE WHEN feature_quality = 'FAILED' THEN {failed} ELSE nullif(concat_ws('; ', cr, ci, {context}), '') END AS alignment_change_warning_reasons, {why("report_side", "report-side")} AS report_side_exclusion_reasons, CASE WHEN feature_quality = 'FAILED' THEN {failed} ELSE {why("alignment_change", "alignment-change")} END AS alignment_change_exclusion_reasons,
      {", ".join(f"{n}_signal_quality IN ('GOOD', 'USABLE') AND NOT is_transition AND NOT irregular_gap AS {n}_primary_eligible" for n in ("report_side", "alignment_change"))} FROM d)
    SELECT * EXCLUDE ({lost}), CASE WHEN 'FAILED' IN (report_side_signal_quality, alignment_change_signal_quality) THEN 'FAILED' WHEN 'NEEDS_REVIEW' IN (report_side_signal_quality, alignment_change_signal_quality) THEN 'NEEDS_REVIEW' WHEN 'USABLE' IN (report_side_signal_quality, alignment_change_signal_quality) THEN 'USABLE' ELSE 'GOOD' END AS language_signal_quality,
      report_side_primary_eligible AND alignment_change_primary_eligible AS primary_eligible, {prefixed("warning")}, {prefixed("exclusion")} FROM e"""


def _measures() -> list[str]:
    two = ("earlier", "later")
    out = [f"{x}_rate_{s}" for x in HITS for s in two] + [f"{x}_rate_{c}" for x in G.CORE for c in ("change", "change_abs")] + [f"substantially_modified_{x}_rate_change" for x in ("positive", "negative", "uncertainty")]
    out += [f"{x}_language_{n}" for x in ("negative", "positive", "risk") for n in ("introduction", "removal")] + ["net_tone_earlier", "net_tone_later", "net_tone_change", "uncertainty_intensity_change", "forward_looking_caution_change", "governance_language_change", "financial_condition_language_change"]
    return out + ["primary_narrative_coverage", "dictionary_match_rate", "dictionary_match_rate_earlier", "dictionary_match_rate_later", "list_content_share", "uncertain_content_share", "ambiguous_alignment_share", "collision_flagged_word_share", "unmatched_word_share"]


@query("pair_language_build", f"SELECT * REPLACE ({', '.join(f'round({x}, 6) AS {x}' for x in _measures())}) FROM ({_language_sql()})")
def pair_language_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All language features of every supplier as a pair, its lines being signal rows."""
    o, part, supplier, q = (F.col(x) for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"))
    k = o % 15
    status = F.when(k == 13, "NEW").when(k == 14, "REMOVED").when(k == 12, "AMBIGUOUS").when(k < 6, "UNCHANGED").otherwise("SUBSTANTIALLY_MODIFIED")
    confidence = F.when(part % 5 == 0, "LOW").when(part % 5 == 1, "NEEDS_REVIEW").when(part % 5 == 2, "MEDIUM").otherwise("HIGH")
    names = ("list_content", "table_context", "currency_exposure_table_mixed", "uncertain", "caption_or_label_like", "numeric_or_table_like_source")
    category = F.get(F.array(*[F.lit(x) for x in names]), ((o + F.col("l_linenumber")) % 13).cast("int"))
    rows = t(spark, sf_dir, "lineitem").select(
        supplier.alias("pair"), F.when(F.col("l_linenumber") % 2 == 0, "EARLIER").otherwise("LATER").alias("report_side"), status.alias("status"), confidence.alias("confidence"), (q * 4).cast("long").alias("words"), category.alias("category"),
        (q >= 10).alias("feature_eligible"), (part % 4 < supplier % 5).alias("collision"), F.when(supplier % 4 == 0, o % 2).otherwise(o % 12).alias("total_hits"), *[((o * (i + 1) + part) % 4).alias(x) for i, x in enumerate(HITS)],
    )
    s = F.col("s_suppkey")
    pairs = t(spark, sf_dir, "supplier").select(
        s.alias("pair"), (s % 7 == 0).alias("is_transition"), (s % 3 == 0).alias("irregular_gap"), F.when(s % 8 == 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED").alias("run_status"), F.when(s % 16 == 0, "one; two").alias("run_review_reason"),
        F.when(s % 19 == 0, "FAILED").when(s % 10 == 1, "NEEDS_REVIEW").otherwise("GOOD").alias("feature_quality"),
    )
    out = G.pair_language_features(pairs, rows, "pair")
    return out.withColumns({x: F.round(x, 6) for x in _measures()})
