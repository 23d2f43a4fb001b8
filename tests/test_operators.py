"""Operators on literal cases and on random ones against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, alignment, features, joins, lexicon, passages, retrieval, search, similarity, validation, windows
from tidemark.sources import files, sinks
from tidemark.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity_matches_definition():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        want = None if not a and not b else 1 - levenshtein(a, b) / max(len(a), len(b))
        assert similarity.edit_similarity(a, b) == (pytest.approx(want) if want is not None else None)


def test_token_metrics(spark):
    data = [(1, ["a", "b"], ["a", "c"]), (2, [], []), (3, ["a"] * 6, ["a"])]
    got = {r.k: r for r in similarity.token_metrics(spark.createDataFrame(data, "k long, a array<string>, b array<string>"), "k", "a", "b", limit=5).collect()}
    assert got[1].diff_similarity == SequenceMatcher(None, ["a", "b"], ["a", "c"], autojunk=False).ratio() and got[1].edit_similarity == 0.5
    assert got[2].diff_similarity is None and got[2].edit_similarity is None
    assert got[3].diff_mode == "SKIPPED_TOKEN_LIMIT" and got[3].diff_similarity is None


def test_term_cosine(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["b"]), (3, [], ["a"]), (4, ["a", "a"], ["a", "b"])], "k long, a array<string>, b array<string>")
    got = {r.k: r.lexical_cosine for r in similarity.term_cosine(df, ["k"], "a", "b").collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] is None and got[4] == pytest.approx(0.5**0.5)


def test_jaccard_and_scores(spark):
    df = spark.createDataFrame([([], [], 0.9, None)], "a array<string>, b array<string>, s double, n double")
    r = df.select(similarity.jaccard(F.col("a"), F.col("b")).alias("e"), similarity.jaccard(F.array(F.lit("x")), F.col("b")).alias("z"), similarity.lexical_composite(F.col("s"), F.col("n")).alias("c"), similarity.content_score(F.col("s"), F.col("n"), F.col("n")).alias("k"), similarity.position_difference(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("p")).first()
    assert r.e is None and r.z == 0.0 and r.c == 0.9 and r.k == pytest.approx(0.5) and r.p == 1.0


def test_current_runs(spark):
    runs = spark.createDataFrame([("a", "COMPLETED", 1, "r1"), ("a", "COMPLETED", 2, "r2"), ("a", "FAILED", 3, "r3"), ("b", "FAILED", 1, "r4"), ("c", "COMPLETED_WITH_WARNINGS", 5, "r5"), ("c", "COMPLETED", 5, "r6")], "k string, status string, done int, id string")
    assert [r.id for r in windows.current_runs(runs, ["k"], "status", "done", "id").orderBy("k").collect()] == ["r2", "r6"]
    assert [r.id for r in windows.current_runs(runs, ["k"], "status", "done", "id", n=2).orderBy("k").collect()] == ["r1", "r5"]


def test_discovery_ranks(spark):
    items = spark.createDataFrame([("s", 1, 5.0, "x"), ("s", 2, 7.0, "x"), ("s", 3, 7.0, "y")], "signal string, id int, m double, c string")
    got = {(r.rank_scope, r.id): (r["rank"], round(r.percentile, 3)) for r in windows.discovery_ranks(items, {"global": [], "company": ["c"]}, "signal", "m", "id", top=2).collect()}
    assert got == {("global", 2): (1, 100.0), ("global", 3): (2, 66.667), ("company|x", 2): (1, 100.0), ("company|x", 1): (2, 50.0), ("company|y", 3): (1, 100.0)}


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    right = spark.createDataFrame([("p", 1, 2), ("q", 1, 1), ("r", None, 2)], "c string, a long, b long")
    assert rows(joins.either_side(left, "id", right, ("a", "b")).select("id", "c")) == [(1, "p"), (1, "q"), (2, "p"), (2, "r"), (3, None)]
    spans = spark.createDataFrame([("k", 0, 10), ("k", 95, 130), ("k", 5, 5)], "k string, start long, end long")
    others = spark.createDataFrame([("k", 9, 120), ("k", 10, 11), ("j", 0, 5)], "k string, o_start long, o_end long")
    assert rows(joins.overlapping(spans, others, "k", 20).select("start", "o_start")) == [(0, 9), (95, 9)]
    assert rows(joins.with_ordered_array(left, right.select(F.col("a").alias("id"), "c"), "id", "c", "cs")) == [(1, ["p", "q"]), (2, []), (3, [])]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None)], "k long, s string")
    assert rows(aggregates.composition(df, "k", "s", ("a", "b"))) == [(1, "a", 2, 1.0), (1, "b", 0, 0.0), (2, "a", 0, None), (2, "b", 0, None)]
    assert rows(aggregates.capped_count(df, 2)) == [(2, True)] and rows(aggregates.capped_count(df, 4)) == [(4, False)]
    assert aggregates.page_state(101, 9) == {"page": 3, "pages": 3, "has_previous": True, "has_next": False}
    assert rows(aggregates.page(df.select("k").withColumn("i", F.monotonically_increasing_id()), [F.col("i")], 2, 3).select("position")) == [(4,)]


def test_features(spark):
    data = [(1, "UNCHANGED", 100, 100), (1, "NEW", None, 50), (1, "REMOVED", 30, None), (1, "AMBIGUOUS", 60, 60)]
    df = spark.createDataFrame(data, "p long, status string, earlier_words long, later_words long")
    o = features.outcomes(df, ["p"]).first()
    assert (o.unchanged_words, o.new_words, o.removed_words, o.eligible_removed_words, o.eligible_ambiguous_count) == (100.0, 50.0, 30.0, 0.0, 1)
    c = features.coverage(df, ["p"]).first()
    assert c.coverage_words == pytest.approx(200 / 400) and c.coverage_count == pytest.approx(2 / 6)
    full = features.outcomes(df, ["p"]).select(features.score(features.rates(), F.lit(0.9)).alias("s"), features.score(features.rates(), F.lit(0.5)).alias("n")).first()
    assert full.s == pytest.approx((50 * 0.85 + 60 * 0.5) / 210) and full.n is None
    q = spark.range(1).select(features.stricter(F.lit("GOOD"), F.lit("USABLE")).alias("q"), features.meets(F.lit(None).cast("string"), "GOOD").alias("m"), features.dominant({"a": F.lit(1.0), "b": F.lit(1.0)}).alias("d")).first()
    assert (q.q, q.m, q.d) == ("USABLE", False, "a")
    s = spark.range(1).select(features.alignment_status(F.lit(0.96), F.lit(0.95), F.lit(0.9)).alias("u"), features.alignment_status(F.lit(0.96), F.lit(0.5), F.lit(0.9)).alias("l"), features.alignment_confidence(F.lit(None).cast("double")).alias("h"), features.alignment_confidence(F.lit(0.05)).alias("m")).first()
    assert tuple(s) == ("UNCHANGED", "LIGHTLY_MODIFIED", "HIGH", "MEDIUM")


def test_lexicon(spark):
    keys = {("net", "loss"): 1, ("loss",): 1, ("going", "concern"): 1}
    assert lexicon.matches("a net loss and loss of going-concern".split(), keys, 2) == [(1, 2, ("net", "loss")), (4, 1, ("loss",)), (6, 1, ("going", "concern"))]
    assert lexicon.negated("we do not expect any loss but risk".split()) == {3, 4, 5}
    df = spark.createDataFrame([(1, "No loss. A net loss, however risk."), (2, None)], "id long, text string")
    got = rows(lexicon.signals(df, "id", "text", [("loss", "negative"), ("net loss", "negative"), ("risk", "risk"), ("loss", "finance")]))
    assert got == [(1, "finance", 1, 1), (1, "negative", 2, 1), (1, "risk", 1, 0)]
    wide = spark.createDataFrame([("ABANDON", "2009", "0"), ("Gain", None, "2011"), ("bad", "x", "0")], "Word string, Negative string, Positive string")
    assert rows(lexicon.wide_to_long(wide, "Word", ["Negative", "Positive"])) == [("abandon", "negative"), ("gain", "positive")]


def test_alignment(spark):
    p = spark.createDataFrame([("k", 1, 10, 0.9), ("k", 2, 10, 0.9), ("k", 2, 11, 0.5), ("k", 3, 12, 0.2)], "k string, l_idx long, e_idx long, score double")
    m = alignment.assigned(p, "k")
    assert rows(m) == [("k", 1, 10, 0.9), ("k", 2, 11, 0.5)]
    assert alignment.exchanged({1: 10, 2: 11}, {(1, 10): 0.9, (2, 11): 0.1, (1, 11): 0.8, (2, 10): 0.8}) == {1: 11, 2: 10}
    e, later = (spark.createDataFrame([("k", i) for i in x], "k string, idx long") for x in ((10, 11, 12), (1, 2, 3)))
    assert rows(alignment.assembled(e, later, m, "k").select("l_idx", "e_idx", "status")) == [(1, 10, "MATCHED"), (2, 11, "MATCHED"), (3, None, "NEW"), (None, 12, "REMOVED")]
    assert {r.l_idx: r.rivals for r in alignment.collisions(p, "k").where("e_idx = 10").collect()} == {1: 1, 2: 1}


def test_segments():
    words = lambda n: " ".join(["word"] * n)
    out = passages.segments([("PAGE_NUMBER", "3"), ("HEADING", "One"), ("PARAGRAPH", words(200)), ("PARAGRAPH", words(100)), ("PARAGRAPH", words(30)), ("HEADING", "Two"), ("PARAGRAPH", words(390)), ("PARAGRAPH", words(20))])
    assert [(p["heading"], p["words"]) for p in out] == [("One", 330), ("Two", 390), ("Two", 20)]
    assert passages.segments([("PARAGRAPH", "too short")])[0]["excluded"] == "short"
    assert passages.segments([]) == []


def test_windows_and_diff():
    text = " ".join(f"w{i}." if i % 10 == 9 else f"w{i}" for i in range(100))
    spans = passages.overlapping_windows(text, lambda w: 1, 30, 5, 40)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] + 1 >= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(text[a:b].endswith(".") for a, b in spans)
    assert passages.fixed_windows(600) == [(0, 256), (192, 448), (384, 600)] and passages.fixed_windows(0) == []
    assert passages.word_diff("a b c", "a x c") == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]
    assert passages.word_diff("a" * 30000, "b") is None


def test_retrieval(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    assert [r.id for r in retrieval.fused(a, b).orderBy("rank").collect()] == ["y", "x", "z"]
    ranked = spark.createDataFrame([("c", "p", 1), ("c", "q", 2), ("d", "p", 1)], "case_id string, id string, rank int")
    judged = spark.createDataFrame([("c", "q", 3), ("c", "r", 1)], "case_id string, id string, gain int")
    got = {r.case_id: r for r in retrieval.measures(ranked, judged, 2).collect()}
    assert (got["c"].recall, got["c"].precision, got["c"].reciprocal_rank) == (0.5, 0.5, 0.5) and (got["d"].recall, got["d"].ndcg) == (1.0, None)


def test_search(spark):
    q = search.parsed('"net debt" ratio OR cash -loss')
    assert q.groups == (("net debt", "ratio"), ("cash",)) and q.without == ("loss",)
    docs = spark.createDataFrame([(1, "Net debt ratio"), (2, "debt net ratio"), (3, "cash"), (4, "cash loss")], "id long, text string")
    assert {r.id for r in search.keyword_search(docs, "id", "text", q, 10).collect()} == {1, 3}


def test_validation(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "k string, i long")
    r = validation.report({"contiguous": validation.not_contiguous(df, ["k"], "i"), "unique": validation.repeated(df, ["k", "i"])})
    assert rows(r) == [("contiguous", 1), ("unique", 0)]
    assert validation.summary_json(r).first().summary == '{"passed":false,"checks_run":2,"failures":["contiguous"]}'


def test_sources(spark, tmp_path):
    for p in ("acme/2020/a.pdf", "acme/2021/b.pdf", "loose.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    got = {r.path: (r.directory_year, r.company_hint) for r in files.scanned(spark, str(tmp_path)).collect()}
    assert got == {"acme/2020/a.pdf": (2020, "acme"), "acme/2021/b.pdf": (2021, "acme"), "loose.pdf": (None, None)}
    h = "a" * 64
    m = spark.createDataFrame([(2, " abc ", "p", h.upper(), "2020"), (3, "abc", "p", "b" * 64, "2020"), (4, "abc", "q", "zz", "2020"), (5, "xyz", "r", "c" * 64, "2020"), (6, "abc", "s", "d" * 64, "1800")], "row_number int, company string, local_path string, sha256 string, directory_year string")
    good, bad = files.validated(m, spark.createDataFrame([("ABC",)], "ticker string"))
    assert rows(good) == [(2, "ABC", "p", h, 2020)]
    assert {r.row_number: r.reason for r in bad.collect()} == {3: "repeated path", 4: "bad hash", 5: "unknown company", 6: "bad year"}


def test_publication(spark, tmp_path):
    state = spark.createDataFrame([("p1", "ACTIVE", 1), ("p2", "READY", 2), ("p3", "FAILED", None)], "publication_id string, status string, completed_at int")
    after = sinks.activated(state, "p2")
    assert {r.publication_id: r.status for r in after.collect()} == {"p1": "SUPERSEDED", "p2": "ACTIVE", "p3": "FAILED"}
    with pytest.raises(Exception, match="not ready"):
        sinks.activated(state, "p3").collect()
    for p in ("p1", "p2"):
        sinks.publish({"t": spark.createDataFrame([(p,)], "v string")}, str(tmp_path), p)
    assert [r.v for r in sinks.current(spark, str(tmp_path), "t", after).collect()] == ["p2"]
    assert {r.publication_id for r in sinks.removable(after, keep=0).collect()} == {"p1", "p3"}


def test_incremental(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    done = spark.createDataFrame([(1, "f"), (2, "g")], "id long, fingerprint string")
    assert [r.id for r in incremental.pending(items, done, ["id"], "f").collect()] == [2]
    assert incremental.pending(items, done, ["id"], "f", force=True).count() == 2
    assert files.fingerprint({"b": 1, "a": 2}) == files.fingerprint({"a": 2, "b": 1})


def test_contracts():
    with pytest.raises(ValueError, match="same store"):
        sinks.distinct_stores("file:/a/b/", "/a/b")
    sinks.distinct_stores("/a", "/a", allow_same=True)
    with pytest.raises(ValueError, match="dimension"):
        sinks.same_contract({"model": "m", "revision": "r", "dimension": 3}, {"model": "m", "revision": "r", "dimension": 4})


def test_compatible_form(spark):
    from tidemark.functions import text

    df = spark.createDataFrame([("plain",), ("ﬁne ２",), (None,)], "s string")
    assert [r.v for r in df.select(text.compatible_form(F.col("s")).alias("v")).collect()] == ["plain", "fine 2", None]
