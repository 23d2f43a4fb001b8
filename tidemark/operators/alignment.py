"""Aligning the passages of two texts: nearest candidates, greedy assignment, exchanges, splits, merges and collisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

from .features import MATCHED

#: Candidates of a passage, similarity that one needs, score that a match needs, sweeps of exchanges (fixed values).
NEAREST, FLOOR, ACCEPT, SWEEPS = 5, 0.50, 0.45, 3
#: Scores that hint at a split near and far, and how near is near (fixed values).
SPLIT_NEAR, SPLIT_FAR, NEAR = 0.35, 0.65, 3
#: Months between reports beyond which a gap is irregular (fixed value).
LONG_GAP = 18


#: Passages of a block of either side.
BLOCK = 2048


def candidates(earlier: DataFrame, later: DataFrame, key: str, k: int = NEAREST, floor: float = FLOOR) -> DataFrame:
    """The k nearest earlier passages of each later one within the same key; the floor applies after the cut.

    Both sides have key, idx and vec. The passages of a key are dealt to blocks, each block of one side meets each of the
    other as matrices, and only the k best of a block go on, so neither a hot key nor its pairs gather in one task.
    Vectors without direction, null ones and those of another dimension are no candidates.
    """
    sizes = [df.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c)) for df, c in ((earlier, "_eb"), (later, "_lb"))]
    plan = sizes[0].join(sizes[1], key)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.select(key, F.col("idx").cast("long").alias("idx"), "vec").where("vec is not null").join(plan, key)
        return df.withColumn("_own", F.pmod(F.xxhash64("idx"), F.col(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(key, "idx", "vec", "_own", "_other")

    e = dealt(earlier, "_eb", "_lb").select(key, "idx", "vec", F.col("_own").alias("_e"), F.col("_other").alias("_l"), F.lit(True).alias("_earlier"))
    w = dealt(later, "_lb", "_eb").select(key, "idx", "vec", F.col("_other").alias("_e"), F.col("_own").alias("_l"), F.lit(False).alias("_earlier"))
    kind = later.schema[key].dataType.simpleString()

    def nearest(both: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, some in both.groupby(both["vec"].map(len)):
            x, y = some[some["_earlier"]], some[~some["_earlier"]]
            if not len(x) or not len(y):
                continue
            m, v = (np.array(list(f["vec"]), np.float64) for f in (x, y))
            ids = x["idx"].to_numpy()
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (v @ m.T) / (np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((m * m).sum(axis=1))[None, :])
            for own, row in zip(y["idx"], score, strict=True):
                known = np.flatnonzero(np.isfinite(row))
                best = known[np.lexsort((ids[known], -np.round(row[known], 9)))[:k]]
                parts.append(pd.DataFrame({key: y[key].iloc[0], "l_idx": own, "e_idx": ids[best], "similarity": row[best]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[key, "l_idx", "e_idx", "similarity"])

    found = e.unionByName(w).groupBy(key, "_e", "_l").applyInPandas(nearest, f"{key} {kind}, l_idx long, e_idx long, similarity double")
    rank = F.row_number().over(Window.partitionBy(key, "l_idx").orderBy(F.desc(F.round("similarity", 9)), "e_idx"))
    return found.withColumn("candidate_rank", rank).where(F.col("candidate_rank") <= k).where(F.col("similarity") >= floor)


def exchanged(match: dict[int, int], score: dict[tuple[int, int], float]) -> dict[int, int]:
    """At most one swap of partners a sweep, where both new pairs are known candidates and their sum is strictly better.

    Matches are tried by earlier index, each with its own candidates, best first, ties to the smaller earlier index.
    """
    options: dict[int, list[int]] = {}
    for w, e in sorted(score, key=lambda pair: (-score[pair], pair[1])):
        options.setdefault(w, []).append(e)

    def better() -> tuple[int, int] | None:
        owner = {e: w for w, e in match.items()}
        for a in sorted(match, key=lambda w: match[w]):
            for e in options[a]:
                b = owner.get(e)
                if b is None or b == a or (b, match[a]) not in score:
                    continue
                if score[a, e] + score[b, match[a]] > score[a, match[a]] + score[b, e]:
                    return a, b
        return None

    for _ in range(SWEEPS):
        pair = better()
        if pair is None:
            break
        a, b = pair
        match[a], match[b] = match[b], match[a]
    return match


def assigned(proposals: DataFrame, key: str, accept: float = ACCEPT, content: str = "score", claims: bool = False) -> DataFrame:
    """One-to-one matches (key, l_idx, e_idx, score): best score first, ties by later then earlier index, then exchanges.

    `content` names the score that a proposal needs for acceptance; `score` orders them. Exchanges may use every candidate.
    With claims, `claim` is the place in which a later passage took its partner. Greedy choice is sequential by nature; a
    group is one pair of texts, whose passages bound it. A pair proposed twice counts once, with its best score.
    """
    names = [key, "l_idx", "e_idx", "score"] + (["claim"] if claims else [])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "l_idx", "e_idx"], ascending=[False, True, True]).drop_duplicates(["l_idx", "e_idx"])
        score = {(int(w), int(e)): float(s) for w, e, s in zip(g["l_idx"], g["e_idx"], g["score"], strict=True)}
        match: dict[int, int] = {}
        used: set[int] = set()
        for w, e, c in zip(g["l_idx"], g["e_idx"], g["_content"], strict=True):
            if c >= accept and int(w) not in match and int(e) not in used:
                match[int(w)] = int(e)
                used.add(int(e))
        claim = {w: i for i, w in enumerate(match)}
        k = g[key].iloc[0]
        rows = [(k, w, e, score[w, e], claim[w]) for w, e in sorted(exchanged(match, score).items())]
        return pd.DataFrame(rows, columns=[key, "l_idx", "e_idx", "score", "claim"])[names]

    kind = proposals.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, l_idx long, e_idx long, score double" + (", claim long" if claims else "")
    ready = proposals.where("l_idx is not null and e_idx is not null and score is not null")
    return ready.select(key, "l_idx", "e_idx", "score", F.col(content).alias("_content")).groupBy(key).applyInPandas(run, schema)


def _apart(score: str, gap: Column) -> Column:
    """Whether a candidate says enough: a low bar within a few places, a high one beyond."""
    return F.when(gap <= NEAR, F.col(score) >= SPLIT_NEAR).otherwise(F.col(score) >= SPLIT_FAR)


def _places(gap: Column) -> Column:
    return F.when(gap == 1, F.lit("adjacent")).otherwise(F.concat(gap.cast("string"), F.lit(" passages apart")))


def split_flags(proposals: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, l_idx, split_of, owner, note): unmatched later passages that also propose an earlier one which `owner` took.

    The passage's own best such candidate counts, ties to the smaller earlier index.
    """
    free = proposals.join(matches.select(key, "l_idx"), [key, "l_idx"], "left_anti")
    gap = F.abs(F.col("l_idx") - F.col("owner"))
    hits = free.join(matches.select(key, "e_idx", F.col("l_idx").alias("owner")), [key, "e_idx"]).where(_apart("score", gap))
    best = hits.groupBy(key, "l_idx").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("e_idx"), F.col("owner"))).alias("b"))
    best = best.select(key, "l_idx", F.col("b.e_idx").alias("split_of"), F.col("b.owner").alias("owner"))
    return best.withColumn("note", F.concat(F.lit("likely split ("), _places(gap), F.lit("): also matches the earlier passage taken by later passage "), F.col("owner").cast("string")))


def merge_flags(proposals: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """(key, e_idx, merged_into, owner, note): unmatched earlier passages that a matched later one proposes besides its
    partner `owner`. Of several later ones that which claimed first counts (column claim, without it the smaller index).
    """
    first = F.col("claim") if "claim" in matches.columns else F.col("l_idx")
    taken = matches.select(key, "l_idx", F.col("e_idx").alias("owner"), first.alias("_first"))
    free = proposals.join(matches.select(key, "e_idx"), [key, "e_idx"], "left_anti")
    gap = F.abs(F.col("e_idx") - F.col("owner"))
    hits = free.join(taken, [key, "l_idx"]).where(_apart("score", gap))
    best = hits.groupBy(key, "e_idx").agg(F.min(F.struct("_first", "l_idx", "owner")).alias("b"))
    best = best.select(key, "e_idx", F.col("b.l_idx").alias("merged_into"), F.col("b.owner").alias("owner"))
    return best.withColumn("note", F.concat(F.lit("likely merge ("), _places(gap), F.lit("): also proposed for the later passage matched to earlier passage "), F.col("owner").cast("string")))


def collisions(proposals: DataFrame, key: str, accept: float = ACCEPT) -> DataFrame:
    """proposals with `rivals`: other later passages that clear the bar on the same earlier one."""
    n = F.count_if(F.col("score") >= accept).over(Window.partitionBy(key, "e_idx"))
    return proposals.withColumn("rivals", n - (F.col("score") >= accept).cast("long"))


def collision_flags(proposals: DataFrame, matches: DataFrame, earlier: DataFrame, key: str, digest: str = "digest", accept: float = ACCEPT, content: str = "score") -> DataFrame:
    """(key, l_idx, rivals, duplicated, note) of matches in doubt: others clear the bar on the same earlier passage, or
    else another earlier passage has the same digest. A null digest equals none.
    """
    bar = proposals.where(F.col(content) >= accept).groupBy(key, "e_idx").agg(F.countDistinct("l_idx").alias("_n"))
    own = proposals.where(F.col(content) >= accept).select(key, "l_idx", "e_idx", F.lit(1).alias("_own")).distinct()
    same = earlier.where(F.col(digest).isNotNull()).groupBy(key, digest).agg(F.countDistinct("idx").alias("_m")).where("_m > 1")
    twice = earlier.select(key, F.col("idx").alias("e_idx"), digest).join(same, [key, digest], "left_semi").select(key, "e_idx", F.lit(True).alias("_twice")).distinct()
    m = matches.select(key, "l_idx", "e_idx").join(bar, [key, "e_idx"], "left").join(own, [key, "l_idx", "e_idx"], "left").join(twice, [key, "e_idx"], "left")
    rivals = (F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))).cast("long")
    out = m.select(key, "l_idx", rivals.alias("rivals"), F.coalesce("_twice", F.lit(False)).alias("duplicated")).where("rivals > 0 or duplicated")
    note = F.when(F.col("rivals") > 0, F.concat(F.lit("earlier passage also proposed by "), F.col("rivals").cast("string"), F.lit(" other later passages, match may be arbitrary"))).otherwise(F.lit("earlier passage duplicates another earlier one, match cannot be disambiguated"))
    return out.withColumn("note", note)


def assembled(earlier: DataFrame, later: DataFrame, matches: DataFrame, key: str, splits: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """Matched, NEW and REMOVED rows: (key, l_idx, e_idx, score, status), one for each passage.

    Given splits or merges, an unmatched passage among them is AMBIGUOUS in place of NEW or REMOVED, and `note` says why.
    """
    noted = splits is not None or merges is not None
    l, e = later.select(key, F.col("idx").alias("l_idx")), earlier.select(key, F.col("idx").alias("e_idx"))
    right = l.join(matches.select(key, "l_idx", "e_idx", "score"), [key, "l_idx"], "left")
    gone = e.join(matches.select(key, "e_idx"), [key, "e_idx"], "left_anti")
    none = F.lit(None).cast("string").alias("note")
    right = right.select("*", none) if splits is None else right.join(splits.select(key, "l_idx", "note"), [key, "l_idx"], "left")
    gone = gone.select("*", none) if merges is None else gone.join(merges.select(key, "e_idx", "note"), [key, "e_idx"], "left")
    doubt = F.when(F.col("note").isNotNull(), F.lit("AMBIGUOUS"))
    right = right.withColumn("status", F.when(F.col("e_idx").isNotNull(), F.lit("MATCHED")).otherwise(F.coalesce(doubt, F.lit("NEW"))))
    gone = gone.select(key, F.lit(None).cast("long").alias("l_idx"), "e_idx", F.lit(None).cast("double").alias("score"), "note", F.coalesce(doubt, F.lit("REMOVED")).alias("status"))
    names = [key, "l_idx", "e_idx", "score", "status"] + (["note"] if noted else [])
    return right.select(*names).unionByName(gone.select(*names))


def run_summary(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """A row for each of pairs (key, earlier_quality, later_quality, is_transition, gap_months): counts of every status,
    and the warnings of the run; a run with any is COMPLETED_WITH_WARNINGS. A pair without passages has counts of 0.
    """
    statuses = (*MATCHED, "NEW", "REMOVED", "AMBIGUOUS")
    each = [F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in statuses]
    counts = rows.groupBy(key).agg(F.count_if(F.col("status").isin("MATCHED", *MATCHED)).alias("matched_count"), *each)
    out = pairs.join(counts, key, "left").fillna(0, ["matched_count", *[f"{s.lower()}_count" for s in statuses]])
    why = T.reasons(
        F.when((F.col("earlier_quality") == "NEEDS_REVIEW") | (F.col("later_quality") == "NEEDS_REVIEW"), F.lit("source extraction quality NEEDS_REVIEW on at least one side")),
        F.when(F.col("is_transition"), F.lit("transition-period pair")),
        F.when(F.col("gap_months") > LONG_GAP, F.concat(F.lit("irregular reporting gap ("), F.col("gap_months").cast("string"), F.lit(" months)"))),
        F.when(F.col("ambiguous_count") > 0, F.concat(F.col("ambiguous_count").cast("string"), F.lit(" ambiguous alignment(s)"))),
    )
    out = out.withColumn("review_reason", why)
    return out.withColumn("run_status", F.when(why.isNull(), F.lit("COMPLETED")).otherwise(F.lit("COMPLETED_WITH_WARNINGS")))
