"""Numbers, dates and vectors as column expressions. Undefined results are null, never 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, null for a zero denominator."""
    return F.when(d != 0, n / d)


def rate_per(n: Column, d: Column, unit: int = 1000) -> Column:
    """n per so many of d, null unless d is positive."""
    return F.when(d > 0, n * unit / d)


def clamped(v: Column) -> Column:
    """v within [0, 1], null if it isn't finite."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def gap_months(a: Column, b: Column) -> Column:
    """Calendar months from a to b, days left aside."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


def irregular(gap: Column, low: int = 9, high: int = 15) -> Column:
    return ~gap.between(low, high)


def phrase_date(text: Column) -> Column:
    """The first `D Month YYYY` of a text as a date, null if impossible."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), F.lit("")), F.lit("d MMMM yyyy")).cast("date")


def spread(*values: Column) -> Column:
    """Largest less smallest of the values that aren't null, if two are there at least."""
    there = F.array_compact(F.array(*values))
    return F.when(F.size(there) >= 2, F.array_max(there) - F.array_min(there))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """a divided by its norm; raises for a zero vector."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 1e-9, x.cast("double") / n).otherwise(F.raise_error(F.lit("zero vector")).cast("double")))


def named_id(namespace: str, name: Column) -> Column:
    """Version 5 UUID of name in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def year_range(text: Column) -> tuple[Column, Column]:
    """January 1 of the first and December 31 of the last year that a text names."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.make_date(F.array_min(years), F.lit(1), F.lit(1)), F.make_date(F.array_max(years), F.lit(12), F.lit(31))
