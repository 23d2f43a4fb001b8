"""Question answering without a model: analysis, routing, evidence choice, coherence and the gate before an answer."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.operators.features import LOW_WORDS

# Words that carry no concept.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "is", "are", "was", "were", "did", "does", "what", "how", "why", "who", "which", "with", "about", "that", "this", "these", "those", "it", "its", "as", "at",
    "by", "from", "be", "has", "have", "had", "will", "would", "could", "should", "than", "then", "there", "their",
)
# Patterns of directions, of alignment statuses, of sides and of kinds of questions; the first that fits decides a direction or kind.
DIRECTIONS = {
    "increased": r"\b(increased?|rose|grew|higher|rising|up from|growth in)\b",
    "decreased": r"\b(decreased?|fell|declined?|lower|falling|down from|reduction in)\b",
    "added": r"\b(added|newly introduced|introduced for the first time)\b",
    "removed": r"\b(removed|dropped|discontinued|eliminated|no longer)\b",
    "changed": r"\b(changed|modified|updated|revised)\b",
}
STATUSES = {
    "NEW": r"\bnewly (introduced|disclosed|added)\b|\bnew disclosure\b",
    "REMOVED": r"\bno longer (disclosed|reported|mentioned)\b|\bremoved disclosure\b",
    "UNCHANGED": r"\bunchanged\b|\bstayed the same\b",
    "LIGHTLY_MODIFIED": r"\bslightly (modified|changed|updated)\b",
    "SUBSTANTIALLY_MODIFIED": r"\b(substantially|materially|significantly) (modified|changed|revised)\b",
    "AMBIGUOUS": r"\bambiguous\b|\bunclear (change|status)\b",
}
SIDES = {"EARLIER": r"\b(earlier|prior|previous|last year'?s?|preceding)\b", "LATER": r"\b(later|latest|current|most recent|this year'?s?|new(est)? report)\b"}
CAUSAL, QUANTITY = r"\bwhy\b|\bwhat (caused|led to|is the reason)\b|\breason for\b", r"\bhow much\b|\bhow many\b|\bwhat (percentage|amount|proportion)\b"
COMPARING, EXISTENCE = r"\bcompar(e|ison|ed)\b|\bversus\b|\bvs\.?\b|\bdifference between\b", r"\bdoes\b|\bdid\b|\bis there\b|\bwas there\b|\bhas the company\b|\bhave they\b"
TIME = r"\bover time\b|\btrend\b|\bhistory\b|\btimeline\b"
#: Least share of required concepts, least and most pieces of evidence (fixed values).
COVERAGE, ENOUGH, MOST = 0.5, 1, 3


def first_match(question: Column, patterns: dict[str, str]) -> Column:
    """The first name in order whose pattern occurs."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(F.lower(question).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def all_matches(question: Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern occurs, in order."""
    return F.array_compact(F.array(*[F.when(F.lower(question).rlike(pattern), F.lit(name)) for name, pattern in patterns.items()]))


def analysed(questions: DataFrame, text: str, tickers: Sequence[str] = ()) -> DataFrame:
    """questions with tickers, years, date range, direction, statuses, sides, kind, scope and concepts."""
    q = F.col(text)
    years = F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))
    low, high = N.year_range(q)
    named = F.array_compact(F.array(*[F.when(q.rlike(rf"\b{t}\b"), F.lit(t)) for t in tickers], F.lit(None).cast("string")))
    out = questions.withColumn("tickers", named).withColumn("years", years).withColumn("from_date", low).withColumn("to_date", high)
    out = out.withColumn("direction", first_match(q, DIRECTIONS)).withColumn("statuses", all_matches(q, STATUSES)).withColumn("sides", all_matches(q, SIDES)).withColumn("concepts", T.concept_terms(q, STOP_WORDS))
    has, several = (lambda pattern: F.lower(q).rlike(pattern)), F.size("years") > 1
    directed = F.col("direction").isNotNull()
    kind = F.when(has(CAUSAL), F.lit("causal")).when(has(QUANTITY), F.lit("quantitative")).when(directed | has(COMPARING), F.lit("comparative")).when(has(EXISTENCE), F.lit("existence_based"))
    scope = F.when(F.size("tickers") != 1, F.lit("corpus_wide")).when(directed | several, F.lit("single_comparison")).otherwise(F.lit("single_company"))
    return out.withColumn("kind", kind.when(several | has(TIME), F.lit("chronological")).otherwise(F.lit("descriptive"))).withColumn("scope", scope)


def routed(question: DataFrame) -> Column:
    """COMPARISON where anything of the question asks for change, CORPUS without one company, else DOCUMENT."""
    change = F.col("kind").isin("comparative", "chronological") | (F.col("scope") == "single_comparison") | F.col("direction").isNotNull() | (F.size("statuses") > 0)
    return F.when(change, F.lit("COMPARISON")).when(F.col("scope") == "corpus_wide", F.lit("CORPUS")).otherwise(F.lit("DOCUMENT"))


def concept_coverage(body: Column, heading: Column, concepts: Column) -> Column:
    """Mean over concepts: 1 for the body, 0.4 for the heading alone; null without concepts."""
    low, top = F.lower(body), F.lower(F.coalesce(heading, F.lit("")))
    each = F.transform(concepts, lambda c: F.when(F.contains(low, c), F.lit(1.0)).when(F.contains(top, c), F.lit(0.4)).otherwise(F.lit(0.0)))
    return F.when(F.size(concepts) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(concepts))


def responsiveness(required: Column, optional: Column, generic: Column, type_met: Column) -> Column:
    """0.8 required and 0.2 optional coverage, less for generic text, 0 where the asked kind isn't met."""
    value = 0.8 * F.coalesce(required, F.lit(0.0)) + 0.2 * F.coalesce(optional, F.lit(0.0))
    return F.when(~type_met, F.lit(0.0)).otherwise(F.when(generic, 0.3 * value).otherwise(value))


def quality_factor(words: Column, heading_only: Column, generic_heading: Column, has_signal: Column) -> Column:
    """What a passage's similarity is worth: fragments less, unless long enough or with a language signal."""
    factor = F.when(heading_only, F.lit(0.5)).when(generic_heading, F.lit(0.6)).when(words < 8, F.lit(0.85)).otherwise(F.lit(1.0))
    return F.when((words >= 16) | has_signal, F.lit(1.0)).otherwise(factor)


def reranked(candidates: DataFrame, key: str, item: str, similarity: Column, factor: Column) -> DataFrame:
    """candidates with original and final rank, by similarity and by similarity times factor."""
    w = Window.partitionBy(key)
    out = candidates.withColumn("_a", F.round(similarity, 9)).withColumn("_b", F.round(similarity * factor, 9))
    out = out.withColumn("original_rank", F.row_number().over(w.orderBy(F.desc("_a"), item)).cast("long")).withColumn("final_rank", F.row_number().over(w.orderBy(F.desc("_b"), item)).cast("long"))
    return out.withColumnRenamed("_b", "adjusted").drop("_a")


def chosen_evidence(candidates: DataFrame, key: str, most: int = MOST, floor: float = 0.0) -> DataFrame:
    """Greedy choice for each question: best first, no text twice, each piece must add a facet. (key, item, place).

    candidates: key, item, score, text, facets (array of strings). Sequential within a question, whose candidates are few.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, texts, covered = [], set(), set()
        for r in g.sort_values(["score", "item"], ascending=[False, True]).itertuples():
            form = " ".join(str(r.text).lower().split())
            new = set(r.facets) - covered
            if r.score < floor or form in texts or (covered and not new):
                continue
            texts.add(form)
            covered |= new
            rows.append((getattr(r, key), r.item, len(rows) + 1))
            if len(rows) == most:
                break
        return pd.DataFrame(rows, columns=[key, "item", "place"])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    return candidates.select(key, "item", "score", "text", "facets").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, item {kinds['item']}, place int")


def coherence(selected: DataFrame, key: str) -> DataFrame:
    """(key, periods, both_sides, conflict): conflict where NEW and REMOVED stand beside each other for one heading.

    selected: key, company, period, side, status, heading.
    """
    a = selected.groupBy(key, "company", "heading").agg(F.bool_or(F.col("status") == "NEW").alias("n"), F.bool_or(F.col("status") == "REMOVED").alias("r"), F.collect_set("period").alias("p"), F.collect_set("side").alias("s"))
    b = a.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("ps"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("ss"), F.bool_or(F.col("n") & F.col("r")).alias("conflict"))
    return b.select(key, F.size("ps").cast("long").alias("periods"), (F.size("ss") >= 2).alias("both_sides"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def gate(pieces: Column, coverage: Column, asks_both: Column, both_sides: Column, conflict: Column) -> tuple[Column, Column]:
    """(status, reason) in fixed precedence: nothing found, conflict, a missing side, thin coverage, else supported."""
    reason = (
        F.when(F.coalesce(pieces, F.lit(0)) < ENOUGH, F.lit("NO_EVIDENCE")).when(F.coalesce(conflict, F.lit(False)), F.lit("CONFLICT")).when(asks_both & ~F.coalesce(both_sides, F.lit(False)), F.lit("ONE_SIDE_ONLY"))
        .when(coverage.isNotNull() & (coverage < COVERAGE), F.lit("THIN_COVERAGE"))
    )
    status = F.when(reason.isNull(), F.lit("SUPPORTED")).when(reason.isin("NO_EVIDENCE", "CONFLICT"), F.lit("ABSTAIN")).otherwise(F.lit("PARTIAL"))
    return status, reason


def failure_stage(relevant_found: Column, in_top: Column, selected: Column, supported: Column) -> Column:
    """Where an answer was lost."""
    return F.when(~relevant_found, F.lit("RETRIEVAL")).when(~in_top, F.lit("RERANK")).when(~selected, F.lit("SELECTION")).when(~supported, F.lit("GATE")).otherwise(F.lit("SUCCESS"))


def floor_percentile(values: Column, p: int) -> Column:
    """The value at index floor(p / 100 * n) of the sorted values, not interpolated."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.least(F.floor(F.lit(p) / 100 * F.size(ordered)), F.size(ordered) - 1).cast("int"))


def default_mode(metrics: DataFrame, tolerance: float = 0.01) -> Column:
    """Hybrid if its nDCG ties or wins and its recall isn't lower, else keyword. metrics: one row with four columns."""
    return F.when((F.col("hybrid_ndcg") >= F.col("keyword_ndcg") - tolerance) & (F.col("hybrid_recall") >= F.col("keyword_recall") - tolerance), F.lit("hybrid")).otherwise(F.lit("keyword"))


def low_information(words: Column) -> Column:
    return words < LOW_WORDS
