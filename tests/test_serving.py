"""Parameters, optional filters, block rules and ranks on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexicon, passages, serving, windows


def test_parameters():
    p = serving.parameters({"q": "  debt  ", "company": " abc ", "periodStart": "2020-01-01", "periodEnd": "01/02/2020", "status": "NEW", "confidence": "SURE", "subcategory": "x", "sort": "company", "page": "0", "pageSize": "500", "phrase": "1"})
    assert p == serving.Parameters("debt", True, "ABC", "2020-01-01", None, "NEW", None, None, None, None, None, "company", 1, serving.MOST_ON_PAGE)
    assert serving.parameters({}) == serving.Parameters() and serving.parameters({"q": " ", "sort": "relevance"}).sort == "newest_report"
    assert serving.parameters({"q": "x" * 300}).query == "x" * 200 and serving.parameters({"category": ["risk", "debt"], "subcategory": "y"}).subcategory == "y"
    assert serving.parameters({"q": "x"}).sort == "relevance" and serving.parameters({"pageSize": "abc"}).page_size == serving.PAGE_SIZE


def test_publishable(spark):
    rows = [("UNCHANGED", 1, None), ("UNCHANGED", 1, 2), ("NEW", None, 2), ("NEW", 1, None), ("REMOVED", None, 2), ("REMOVED", 1, None), ("AMBIGUOUS", None, 2), ("AMBIGUOUS", None, None)]
    df = spark.createDataFrame(rows, "status string, e int, w int")
    got = [r.ok for r in df.select(serving.publishable(F.col("status"), F.col("e"), F.col("w")).alias("ok")).collect()]
    assert got == [False, True, True, False, False, True, True, False]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("42", "PAGE_NUMBER"), ("Page 4 of 120", "PAGE_NUMBER"), ("xiv", "PAGE_NUMBER"), ("Governance", "PARAGRAPH"), ("GOVERNANCE", "HEADING"), ("https://www.example.com/reports", "DECORATIVE"), ("O", "DECORATIVE"), ("- item of a list", "LIST_ITEM"), ("", "EMPTY")],
)
def test_block_types(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(passages.block_type(F.col("t")).alias("k")).first().k == kind


def test_overlapping_text(spark):
    df = spark.createDataFrame([("a word here\n" * 30, 5.0), ("a word here\n" * 30, 400.0)], "t string, h double")
    assert [r.k for r in df.select(passages.block_type(F.col("t"), height=F.col("h")).alias("k")).collect()] == ["OVERLAPPING_TEXT", "PARAGRAPH"]


def test_negators_and_conjunctions():
    assert lexicon.negated("it is unlikely to fail yet losses rose".split()) == {3, 4}
    assert lexicon.negated("none nor cannot fail".split()) == set()


@pytest.mark.parametrize("descending", [False, True])
def test_global_rank(spark, monkeypatch, descending):
    monkeypatch.setattr(windows, "SAMPLED", 60)
    rng = random.Random(1)
    rows = [(float(rng.choice([0, 0, 0, rng.randint(-50, 50)])), i) for i in range(900)]
    rng.shuffle(rows)
    got = windows.global_rank(spark.createDataFrame(rows, "m double, i long"), ["m", "i"], "place", descending).collect()
    want = {r: k for k, r in enumerate(sorted(rows, reverse=descending), 1)}
    assert {(r.m, r.i): r.place for r in got} == want
    assert windows.global_rank(spark.createDataFrame([], "m double, i long"), ["m", "i"], "place").count() == 0
