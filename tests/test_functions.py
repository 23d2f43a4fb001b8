"""Column functions on literal cases."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T


def value(spark, column, **given):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", dt.date: "date", list: "array<double>"}
    names = list(given)
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else kinds.get(type(v), 'string')}" for k, v in given.items()) or "x int"
    row = tuple(given[k] for k in names) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (T.clean, "exam-\nple  of\ttext\nwrapped\n\n\nnext\x07 para ", "example of text wrapped\n\nnext para"),
        (T.clean, "Co-\nOp and re-\nUse", "Co- Op and re- Use"),
        (T.tokens, "Don't pay 1,234.50 for the co-op's well-known é!", ["don't", "pay", "1,234.50", "for", "the", "co-op's", "well-known", "é"]),
        (T.word_count, "  a b\n\nc ", 3),
        (T.header_form, " Page  12 of 340 ", "page # of #"),
        (T.sentences, "Up 3.5 percent. Yes! ", ["Up 3", "5 percent", "Yes"]),
        (T.plural, "class", "classes"), (T.plural, "policy", "policies"), (T.plural, "day", "days"), (T.plural, "two words", None),
        (T.spellings, "organize", ["organise"]), (T.spellings, "analyze", ["analyse"]),
        (T.hyphen_parts, "well-known", ["well", "known"]), (T.hyphen_parts, "plain", None),
        (T.fragment_share, "ab\n\nlong enough\n\n1", 2 / 3), (T.fragment_share, "", 1.0),
        (T.repeats_phrase, "a b c d x a, B c d", True), (T.repeats_phrase, "a b c d e", False),
        (T.normal_form, " A  b\nC ", "a b c"),
        (T.redacted_url, "https://u:p@h:80/a/b?q=1#x", "https://h:80/a/b"),
        (T.alias, "Acme Holdings Ltd.", "Acme"),
        (T.grouped_numbers, "1,000 2,000 of 3,000", True), (T.grouped_numbers, "1,000 of 3,000", False), (T.grouped_numbers, "1 000 200 300 400 500 600 700", True), (T.grouped_numbers, "sold 1,000 units last year for 2,000 in all", False),
        (T.query_terms, '"net debt" a Ratio', ["net", "debt", "ratio"]),
    ],
)
def test_text(spark, fn, text, want):
    got = value(spark, fn(F.col("s")), s=text)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_shingles(spark):
    assert value(spark, T.shingles(F.col("w")), w=["a", "b", "c"]) == ["a b", "b c"]
    assert value(spark, T.shingles(F.col("w"), 4), w=["a", "b", "c"]) == []
    assert value(spark, T.shingles(F.col("w"), 3), w=["a", "b", "c"]) == ["a b c"]


def test_expanded(spark):
    assert set(value(spark, T.expanded(F.col("s")), s="organize")) == {"organizes", "organise", "organises"}


def test_excerpt_and_truncation(spark):
    body = "x" * 300 + " profit " + "y" * 400
    got = value(spark, T.excerpt(F.col("s"), F.lit("profit")), s=body)
    assert got.startswith("…") and got.endswith("…") and "profit" in got and len(got) <= 322
    assert value(spark, T.truncated(F.col("s"), 5), s="abcd efgh") == "abcd…" and value(spark, T.truncated(F.col("s"), 9), s="abcd efgh") == "abcd efgh"


def test_reasons_and_labels(spark):
    assert value(spark, T.reasons(F.lit(None).cast("string"), F.lit("a"), F.lit("b"))) == "a; b"
    assert value(spark, T.reasons(F.lit(None).cast("string"))) is None
    assert value(spark, T.citation(F.lit("ABC"), F.lit(2020), F.lit(3), F.lit(5), F.lit("LATER"))) == "ABC, 2020, pp. 3-5, later"
    assert value(spark, T.without_heading(F.col("a"), F.col("b")), a="Risks\n\nWe face", b="Risks") == "We face"


@pytest.mark.parametrize(("v", "want"), [(1.5, 1.0), (-1.0, 0.0), (0.3, 0.3), (float("nan"), None), (float("inf"), None)])
def test_clamped(spark, v, want):
    assert value(spark, N.clamped(F.col("v")), v=v) == want


def test_ratios_and_gaps(spark):
    assert value(spark, N.ratio(F.lit(1.0), F.lit(0))) is None and value(spark, N.rate_per(F.lit(3), F.lit(-1))) is None and value(spark, N.rate_per(F.lit(3), F.lit(100))) == 30
    a, b = dt.date(2020, 1, 31), dt.date(2021, 3, 1)
    assert value(spark, N.gap_months(F.col("a"), F.col("b")), a=a, b=b) == 14
    assert value(spark, N.spread(F.lit(0.2), F.lit(None).cast("double"), F.lit(0.9))) == pytest.approx(0.7) and value(spark, N.spread(F.lit(0.2), F.lit(None).cast("double"))) is None
    assert value(spark, N.phrase_date(F.lit("for the year ended 31 March 2021 and"))) == dt.date(2021, 3, 31) and value(spark, N.phrase_date(F.lit("no date"))) is None


def test_vectors(spark):
    assert value(spark, N.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert value(spark, N.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert value(spark, N.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]


def test_named_id(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert value(spark, N.named_id(ns, F.lit("v1:passages:7"))) == str(uuid.uuid5(uuid.UUID(ns), "v1:passages:7"))


def test_year_range(spark):
    lo, hi = N.year_range(F.lit("between 2019 and 2021"))
    assert (value(spark, lo), value(spark, hi)) == (dt.date(2019, 1, 1), dt.date(2021, 12, 31))
