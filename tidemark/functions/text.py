"""Text scalars as column expressions: cleaning, tokens, sentences, ratios, labels and excerpts.

Every function maps a Column to a Column and gives null for null unless it says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: a number with inner separators, or a word of letters with inner apostrophes or hyphens.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:['’-]\p{L}+)*['’]?"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_control(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def repair_hyphens(text: Column) -> Column:
    """Words broken at a line end by a hyphen between small ASCII letters become one."""
    return F.regexp_replace(text, r"(?<=[a-z])-[ \t]*\n[ \t]*(?=[a-z])", "")


def join_lines(text: Column) -> Column:
    """Two or more line feeds become one blank line, a single one becomes a blank."""
    marked = F.regexp_replace(text, r"\n{2,}", "\u0001")
    return F.regexp_replace(F.regexp_replace(marked, r"\n", " "), "\u0001", "\n\n")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; none is left beside a line feed."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")


def clean(text: Column) -> Column:
    """The cleaning steps in their fixed order, trimmed."""
    return F.regexp_replace(collapse_blanks(join_lines(repair_hyphens(strip_control(text)))), r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def shingles(words: Column, n: int = 2) -> Column:
    """n consecutive tokens each, joined by a blank; empty for fewer than n.

    The tokens are zipped with themselves, shifted, so that words is evaluated n times and not once an element.
    """
    shifted = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(n)])
    grams = F.transform(shifted, lambda s: F.concat_ws(" ", *[s[f"w{i}"] for i in range(n)]))
    return F.slice(grams, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def share_of(text: Column, kind: str) -> Column:
    """Share of characters of a Unicode class, such as Nd or L; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, rf"[^\p{{{kind}}}]+", "")) / n)


def header_form(text: Column) -> Column:
    """What recurring headers share: trimmed, small letters, digit runs as #, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[0-9]+", "#"), r"\s+", " ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sentences(text: Column) -> Column:
    """Stretches between runs of . ! and ?, trimmed, without empty ones; decimals are split too."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def plural(word: Column) -> Column:
    """Sibilants take es, consonant and y become ies, all else s; other than single words stay null."""
    return F.when(~word.rlike(r"^\p{L}+$"), F.lit(None)).when(word.rlike(r"(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike(r"[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).otherwise(F.concat(word, F.lit("s")))


def spellings(word: Column) -> Column:
    """British forms of a word in -ize, -ization and -yze."""
    forms = [F.when(word.rlike(f"{a}$"), F.regexp_replace(word, f"{a}$", b)) for a, b in (("ize", "ise"), ("ization", "isation"), ("yze", "yse"))]
    return F.array_compact(F.array(*forms))


def expanded(word: Column) -> Column:
    """Plural and spelling forms, and spellings of the plural, without the word itself."""
    many = plural(word)
    every = F.concat(F.array(many), spellings(word), F.coalesce(F.when(many.isNotNull(), spellings(many)), F.array().cast("array<string>")), F.transform(spellings(word), plural))
    return F.array_distinct(F.filter(F.array_compact(every), lambda w: w != word))


def hyphen_parts(token: Column) -> Column:
    """The parts of a token with inner hyphens, null if there is but one."""
    parts = F.filter(F.split(token, "-"), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts)


def without_heading(text: Column, heading: Column) -> Column:
    """Text behind its leading heading."""
    rest = F.regexp_replace(F.substring(text, F.length(heading) + 1, F.length(text)), r"^\s+|\s+$", "")
    return F.when(heading.isNotNull() & (F.length(heading) > 0) & F.startswith(F.ltrim(text), heading), rest).otherwise(text)


def fragment_share(text: Column) -> Column:
    """Share of stretches between blank lines with at most 3 letters; 1 if there are none."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), F.trim), lambda x: x != "")
    small = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]+", "")) <= 3
    return once(parts, lambda p: F.when(F.size(p) == 0, F.lit(1.0)).otherwise(F.size(F.filter(p, small)) / F.size(p)))


def repeats_phrase(text: Column, n: int = 4) -> Column:
    """Whether n words in a row, in small letters, occur twice; words are letters a to z and apostrophes."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return once(words, lambda w: once(shingles(w, n), lambda grams: F.size(grams) > F.size(F.array_distinct(grams))))


def normal_form(text: Column) -> Column:
    """For comparing texts: small letters, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def truncated(text: Column, n: int = 320) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def excerpt(text: Column, term: Column, size: int = 320, before: int = 120) -> Column:
    """A window of text around the first occurrence of term, with an ellipsis where text is left out."""
    at = F.greatest(F.instr(F.lower(text), term), F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    body = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.trim(body), F.when(start + size <= F.length(text), F.lit("…")).otherwise(F.lit("")))


def query_terms(query: Column, least: int = 2) -> Column:
    """Distinct terms of a query in small letters, quotes off."""
    parts = F.split(F.regexp_replace(F.lower(query), "[\"“”]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def concept_terms(question: Column, stop_words: Iterable[str], least: int = 3) -> Column:
    """Distinct terms of a question that aren't stop words."""
    parts = F.filter(F.split(F.lower(question), r"[^a-z0-9]+"), lambda t: F.length(t) >= least)
    return F.array_except(parts, F.array(*[F.lit(w) for w in stop_words]))


def any_of(terms: Column) -> Column:
    """Terms as an OR query."""
    return F.array_join(terms, " OR ")


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def citation(ticker: Column, year: Column, first: Column, last: Column, side: Column | None = None) -> Column:
    """Ticker, year and pages, and the side if there is one."""
    pages = F.when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), page_range(first, last)))
    return F.concat_ws(", ", ticker, year.cast("string"), pages, F.lower(side) if side is not None else F.lit(None).cast("string"))


def alias(name: Column) -> Column:
    """A company's name without corporate suffixes."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\b(limited|ltd|plc|inc|corporation|corp|group|holdings|company|co)\b\.?", ""), r"\s+", " "))


def reasons(*each: Column) -> Column:
    """The reasons that apply, joined by a semicolon; null if none does."""
    return F.nullif(F.array_join(F.array_compact(F.array(*each)), "; "), F.lit(""))


def redacted_url(url: Column) -> Column:
    """Scheme, host, port and path of a URL."""
    return F.regexp_replace(F.regexp_replace(url, r"//[^/@]*@", "//"), r"[?#].*$", "")


def grouped_numbers(text: Column) -> Column:
    """Whether numbers grouped in thousands stand as in a table's rows: one of seven separators, or two pairs of neighbours
    with one word between them at most.
    """
    pattern = r"\b[0-9]{1,3}(?:[ ,][0-9]{3})+\b"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    inner = F.slice(gaps, 2, F.greatest(F.size(gaps) - 2, F.lit(0)))
    long = F.exists(hits, lambda h: F.length(F.regexp_replace(h, "[0-9]", "")) >= 7)
    tight = F.filter(inner, lambda g: F.size(F.regexp_extract_all(g, F.lit("[A-Za-z]+"), F.lit(0))) <= 1)
    return long | (F.size(tight) >= 2)


#: Characters that are their own NFKC form, whatever stands beside them: a regular expression's class, not all of them.
STABLE = r"\x00-\x7F¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃА-ҁҊ-ӿ–—‘-‚“-„†-•ぁ-ゖ゠-ヾ一-鿿"


def compatible_form(text: Column) -> Column:
    """Unicode NFKC. A text of STABLE characters is its own form and stays in the JVM; others alone reach Python."""
    @F.pandas_udf(StringType())
    def normalised(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = text.rlike(rf"^[{STABLE}]*+\z")
    return F.when(plain, text).otherwise(normalised(F.when(~plain, text)))
