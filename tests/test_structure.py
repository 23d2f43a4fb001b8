"""Page rules, runs and questions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import questions, runs, structure


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


PROSE = "the group grew its revenue across all regions while costs were held and the board expects this to go on. " * 4
H, C, L, P = "HEADING_WITH_BODY", "TABLE_CONTEXT", "LIST", "PARAGRAPH"
NUMBERS = " ".join(["grew 123"] * 45) + ". "


@pytest.mark.parametrize(
    ("text", "heading", "kind", "item", "want", "action"),
    [
        ("rs", "rs", H, False, "short_fragment_invalid", "EXCLUDE"),
        ("AB", "AB", H, False, "short_fragment_invalid", "REVIEW"),
        ("al\n\na\n\nb\n\nlong enough words", "al", H, False, "broken_fragment_sequence", "EXCLUDE"),
        ("IT\n\nThe systems were renewed.", "IT", H, False, "legitimate_short_abbreviation", "RETAIN"),
        ("IT\n\nsystems renewed", "IT", H, False, "caption_or_label_like", "REVIEW"),
        ("IT\n\nsystems renewed", "IT", P, False, None, None),
        ("a b c\n\nd e f\n\ng h i\n\nand long enough", None, P, False, "broken_fragment_sequence", "EXCLUDE"),
        ("as set out in the GRI tables", "Notes", P, False, "contents_or_index_like", "EXCLUDE"),
        ("Remuneration ..... 112", None, P, False, "contents_or_index_like", "EXCLUDE"),
        (" Table of contents ", None, P, False, "contents_or_index_like", "EXCLUDE"),
        ("Figure 3 shows growth over the years", None, P, False, "caption_or_label_like", "EXCLUDE"),
        ("abcd 1234 5678 efgh ij", None, P, False, "numeric_or_table_like_source", "EXCLUDE"),
        ("abcd 1234 5678 efgh", None, P, False, None, None),
        (NUMBERS + PROSE, None, P, False, "ordinary_prose_false_positive", "RETAIN"),
        (PROSE, None, C, False, "ordinary_prose_false_positive", "RETAIN"),
        (PROSE + "10 000 20 300; 40 500 of 60 700, 80 900", None, C, False, "financial_table_rendered_as_prose", "EXCLUDE"),
        (PROSE + "(2021: 11.3%) and (2020: 9%)", None, C, False, "financial_table_rendered_as_prose", "EXCLUDE"),
        ("Exercise price of series a and series b. " + PROSE, None, C, False, "financial_table_rendered_as_prose", "EXCLUDE"),
        (PROSE, "Top 20 shareholders", C, False, "financial_table_rendered_as_prose", "EXCLUDE"),
        ("Number of meetings 4 4, 4 3, 2 2. " + PROSE, None, C, False, "financial_table_rendered_as_prose", "EXCLUDE"),
        (PROSE + "USD, GBP, EUR and ZAR.", None, C, False, "currency_exposure_table_mixed", "REVIEW"),
        ("plain words beside a table", None, C, True, "table_context", None),
        ("first item of a list", None, L, False, "list_content", None),
        ("a list within prose", None, P, True, "list_content", None),
        (PROSE, "Risks", P, False, None, None),
        ("", None, P, False, None, None),
        (None, None, None, None, None, None),
    ],
)
def test_structured_category(spark, text, heading, kind, item, want, action):
    t, h, k = (F.lit(x).cast("string") for x in (text, heading, kind))
    c = structure.structured_category(t, h, k, F.lit(item).cast("boolean"))
    assert tuple(one(spark, c, structure.structured_action(c, h, k))) == (want, action)


def test_provenance_warns_of_order(spark):
    blocks = spark.createDataFrame([(d, b, p, o, 10) for d in (1, 2) for b, p, o in (("x", 1, 2), ("y", 2, 1), ("z", 2, 2))], "doc int, block string, page int, ord int, words int")
    sources = spark.createDataFrame([(1, 0, 0, "x"), (1, 0, 1, "y"), (1, 1, 0, "z"), (2, 0, 0, "y"), (2, 0, 1, "x"), (2, 1, 0, "z")], "doc int, passage int, place int, block string")
    inverted = structure.inversions(sources, blocks, "doc", "passage", "place", "block", ["page", "ord"])
    words = spark.createDataFrame([(1, 30), (2, 30)], "doc int, passage_words int")
    got = {r.doc: (r.inverted, r.verdict) for r in structure.provenance(blocks, sources, "doc", "block", "words", words, inverted).collect()}
    assert got == {1: (0, "PASSED"), 2: (1, "WARNING")}


def test_fiscal_evidence(spark):
    pages = spark.createDataFrame([(1, 1, "for the year ended 31 March 2021; 12 months ended"), (1, 2, "period ended 31  march 2021"), (2, 1, "year ended 1 May 2020, year ended 2 May 2020, transition report"), (3, 1, "nothing")], "doc int, page int, x string")
    got = {r.doc: (r.proposed, r.confidence, r.months, r.transition) for r in structure.fiscal_evidence(pages, "doc", "page", "x").collect()}
    assert got == {1: (dt.date(2021, 3, 31), "HIGH", 12, False), 2: (dt.date(2020, 5, 1), "MEDIUM", None, True), 3: (None, "NONE", None, False)}


def test_recurring_edges(spark):
    rows = [(1, p, 5.0, 100.0, f"Page {p}") for p in range(1, 6)] + [(1, p, 95.0, 100.0, f"only {'x' * p}") for p in range(1, 6)] + [(1, 1, 50.0, 100.0, "Page 9"), (2, 1, 1.0, 100.0, "Page 1")]
    got = structure.recurring_edges(spark.createDataFrame(rows, "doc int, page int, y double, h double, t string"), "doc", "page", "y", "h", "t")
    assert got.where("is_header").count() == 5 and got.where("is_footer").count() == 0 and got.count() == 12


def test_highlighted(spark):
    got = [(s.text, s.matched) for s in one(spark, structure.highlighted(F.lit("Net debt rose; debts fell. DEBT"), ["debt", "net debt"]))[0]]
    assert got == [("Net debt", True), (" rose; debts fell. ", False), ("DEBT", True)]


def test_fitted():
    parts = {"heading": "h h", "previous": "p p", "text": "One two. Three four.", "next": "n n"}
    count = lambda s: len(s.split())
    assert structure.fitted(parts, count, 8) == {"previous": "p p", "text": "One two. Three four."} | {"next": "n n"}
    assert structure.fitted(parts, count, 2) == {"text": "One two."}


def test_runs(spark):
    items = runs.eligibility(spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "item string, n int"), {"small": F.col("n") < 3, "unknown": F.col("n").isNull()})
    assert {r.item: r.ineligible_reason for r in items.collect()} == {"a": "small", "b": None, "c": "unknown"}
    log = spark.createDataFrame([("b", "f", "i", "COMPLETED")], "item string, fingerprint string, inputs string, status string")
    assert runs.planned(items, log, "f", F.lit("i")).count() == 0 and runs.planned(items, log, "f", F.lit("j")).count() == 1 and runs.planned(items, log, "f", F.lit("i"), force=True).count() == 1
    assert one(spark, runs.moved(F.lit("READY"), "ACTIVE"))[0] == "ACTIVE"
    with pytest.raises(Exception, match="can't become"):
        one(spark, runs.moved(F.lit("FAILED"), "ACTIVE"))


def test_questions(spark):
    q = spark.createDataFrame([("How did ABC risk increase from 2019 to 2021?",), ("What did ABC say in 2020?",), ("Which firms mention water?",)], "q string")
    a = questions.analysed(q, "q", ["ABC"])
    got = [(r.route, r.direction, r.tickers) for r in a.withColumn("route", questions.routed(a)).collect()]
    assert got == [("COMPARISON", "increased", ["ABC"]), ("DOCUMENT", None, ["ABC"]), ("CORPUS", None, [])]
    assert one(spark, questions.concept_coverage(F.lit("Water risk"), F.lit("Supply"), F.array(F.lit("water"), F.lit("supply"))))[0] == pytest.approx(0.7)
    assert one(spark, questions.responsiveness(F.lit(1.0), F.lit(0.5), F.lit(True), F.lit(True)))[0] == pytest.approx(0.27)
    gate = lambda *a: tuple(one(spark, *questions.gate(*map(F.lit, a))))
    assert gate(0, 1.0, False, True, True) == ("ABSTAIN", "NO_EVIDENCE") and gate(2, 0.9, True, False, False) == ("PARTIAL", "ONE_SIDE_ONLY") and gate(2, 0.9, False, False, False) == ("SUPPORTED", None)


def test_chosen_evidence(spark):
    rows = [(1, "a", 0.9, "Same text", ["x"]), (1, "b", 0.8, "same  TEXT", ["y"]), (1, "c", 0.7, "other", ["x"]), (1, "d", 0.6, "more", ["y"]), (1, "e", 0.1, "low", ["z"])]
    got = questions.chosen_evidence(spark.createDataFrame(rows, "q int, item string, score double, text string, facets array<string>"), "q", floor=0.5)
    assert [(r.item, r.place) for r in got.orderBy("place").collect()] == [("a", 1), ("d", 2)]


def test_coherence(spark):
    rows = [(1, "c", "2020", "EARLIER", "NEW", "h"), (1, "c", "2021", "LATER", "REMOVED", "h"), (2, "c", "2020", "LATER", "NEW", "h")]
    got = {r.q: (r.periods, r.both_sides, r.conflict) for r in questions.coherence(spark.createDataFrame(rows, "q int, company string, period string, side string, status string, heading string"), "q").collect()}
    assert got == {1: (2, True, True), 2: (1, False, False)}
