"""Alignment against plain Python: greedy choice with exchanges, splits, merges, collisions and the summary of a run."""

import random

import pytest

from tidemark.operators import alignment as A


def plain(proposals, accept):
    """proposals: (later, earlier, score, content). Matches in the order in which they were claimed."""
    own = {}
    for w, e, s, c in proposals:
        own.setdefault(w, []).append((-s, e, c))
    for c in own.values():
        c.sort()
    match = {}
    for s, w, e in sorted((-s, w, e) for w, e, s, c in proposals if c >= accept):
        if w not in match and e not in match.values():
            match[w] = e
    score = {(w, e): s for w, e, s, _ in proposals}
    for _ in range(3):
        done = True
        for a in sorted(match, key=match.get):
            for _, e, _ in own[a]:
                b = next((w for w in match if match[w] == e), a)
                if a != b and (b, match[a]) in score and score[a, e] + score[b, match[a]] > score[a, match[a]] + score[b, e]:
                    match[a], match[b], done = e, match[a], False
                    break
            if not done:
                break
        if done:
            break
    apart = lambda gap, s: s >= (0.35 if gap <= 3 else 0.65)
    splits, merges = {}, {}
    for w in own:
        if w not in match:
            for s, e, _ in own[w]:
                owner = next((x for x in match if match[x] == e), None)
                if owner is not None and apart(abs(w - owner), -s):
                    splits[w] = e, owner
                    break
    for w, e in match.items():
        for s, other, _ in own[w]:
            if other not in match.values() and other not in merges and apart(abs(other - e), -s):
                merges[other] = w, e
    return match, splits, merges


@pytest.mark.parametrize("seed", range(3))
def test_alignment_matches_plain_python(spark, seed):
    r = random.Random(seed)
    table, want = [], {}
    for k in ("a", "b", "c"):
        pairs = {(w, e) for w in range(30) for e in r.sample(range(30), 4)}
        mine = [(w, e, round(r.uniform(0.2, 1), 1 + seed), round(r.uniform(0.3, 1), 2)) for w, e in sorted(pairs)]
        table += [(k, *p) for p in mine]
        want[k] = plain(mine, 0.45)
    p = spark.createDataFrame(table, "k string, l_idx long, e_idx long, score double, content double").repartition(3)
    m = A.assigned(p, "k", content="content", claims=True).cache()
    for k, (match, splits, merges) in want.items():
        mine = {x.l_idx: x.e_idx for x in m.where(m.k == k).orderBy("claim").collect()}
        assert mine == match and list(mine) == list(match)
        assert {x.l_idx: (x.split_of, x.owner) for x in A.split_flags(p, m, "k").where(f"k = '{k}'").collect()} == splits
        assert {x.e_idx: (x.merged_into, x.owner) for x in A.merge_flags(p, m, "k").where(f"k = '{k}'").collect()} == merges
    assert any(w[1] for w in want.values()) and any(w[2] for w in want.values())


def test_ambiguous_rows_and_warnings(spark):
    p = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 2, 1, 0.4), ("k", 9, 1, 0.5), ("k", 1, 3, 0.36)], "k string, l_idx long, e_idx long, score double")
    m = A.assigned(p, "k")
    e, w = (spark.createDataFrame([("k", i) for i in x], "k string, idx long") for x in ((1, 3, 8), (1, 2, 9)))
    s, g = A.split_flags(p, m, "k"), A.merge_flags(p, m, "k")
    got = {(x.l_idx, x.e_idx): (x.status, x.note) for x in A.assembled(e, w, m, "k", s, g).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "MATCHED", (2, None): "AMBIGUOUS", (9, None): "NEW", (None, 3): "AMBIGUOUS", (None, 8): "REMOVED"}
    assert got[2, None][1] == "likely split (adjacent): also matches the earlier passage taken by later passage 1"
    assert got[None, 3][1] == "likely merge (2 passages apart): also proposed for the later passage matched to earlier passage 1"
    pairs = spark.createDataFrame([("k", "GOOD", "NEEDS_REVIEW", True, 19), ("none", "GOOD", None, False, 18)], "k string, earlier_quality string, later_quality string, is_transition boolean, gap_months int")
    out = {x.k: x for x in A.run_summary(A.assembled(e, w, m, "k", s, g), pairs, "k").collect()}
    assert (out["k"].matched_count, out["k"].new_count, out["k"].removed_count, out["k"].ambiguous_count) == (1, 1, 1, 2)
    assert out["k"].review_reason == "source extraction quality NEEDS_REVIEW on at least one side; transition-period pair; irregular reporting gap (19 months); 2 ambiguous alignment(s)"
    assert (out["none"].matched_count, out["none"].review_reason, out["none"].run_status) == (0, None, "COMPLETED")


def test_collisions_by_rivals_and_by_digest(spark):
    p = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 2, 1, 0.5), ("k", 3, 3, 0.9), ("k", 4, 4, 0.9), ("k", 5, 4, 0.44)], "k string, l_idx long, e_idx long, score double")
    e = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, None), ("k", 5, None)], "k string, idx long, digest string")
    got = {x.l_idx: (x.rivals, x.duplicated, "arbitrary" in x.note) for x in A.collision_flags(p, A.assigned(p, "k"), e, "k").collect()}
    assert got == {1: (1, True, True), 3: (0, True, False)}


def test_no_candidates(spark):
    p = spark.createDataFrame([], "k string, l_idx long, e_idx long, score double")
    e = spark.createDataFrame([("k", 1)], "k string, idx long")
    m = A.assigned(p, "k")
    assert [x.status for x in A.assembled(e, e.limit(0), m, "k", A.split_flags(p, m, "k"), A.merge_flags(p, m, "k")).collect()] == ["REMOVED"]
