"""Dictionary matching: phrases before words, negation within a sentence, and rates of what was found."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T

#: Words that a negator reaches ahead, words that end its reach, characters that end a sentence (fixed values).
REACH = 5
NEGATORS = frozenset("not no never neither without unlikely".split())
STOPS = frozenset("but however although though yet".split())
_SENTENCE = re.compile(r"[.!?]+")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*['’]?")


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def matches(tokens: list[str], keys: dict[tuple[str, ...], object], longest: int) -> list[tuple[int, int, tuple[str, ...]]]:
    """(position, tokens used, key): left to right, longest first, no token used twice; hyphen parts only if nothing else fits."""
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            if (key := tuple(tokens[i : i + n])) in keys:
                out.append((i, n, key))
                i += n
                break
        else:
            parts = tuple(p for p in tokens[i].split("-") if p)
            if len(parts) > 1 and parts in keys:
                out.append((i, 1, parts))
            i += 1
    return out


def negated(tokens: list[str]) -> set[int]:
    """Positions within reach of a negator, up to a word that ends it."""
    out: set[int] = set()
    for i, t in enumerate(tokens):
        if t in NEGATORS:
            for j in range(i + 1, min(len(tokens), i + 1 + REACH)):
                if tokens[j] in STOPS:
                    break
                out.add(j)
    return out


def signals(passages: DataFrame, key: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """(key, category, hits, negated): every category of a matched term counts, negated hits too.

    terms: (term, category), a lexicon that fits a driver; it goes to the workers with the function.
    """
    keys: dict[tuple[str, ...], list[str]] = {}
    for term, category in terms:
        keys.setdefault(tuple(words_of(term)), []).append(category)
    longest = max(map(len, keys), default=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for k, body in zip(f[key], f[text], strict=True):
                found: dict[str, list[int]] = {}
                for sentence in _SENTENCE.split(body or ""):
                    tokens = words_of(sentence)
                    under = negated(tokens)
                    for at, _, hit in matches(tokens, keys, longest):
                        for category in keys[hit]:
                            n = found.setdefault(category, [0, 0])
                            n[0] += 1
                            n[1] += at in under
                rows += [(k, c, *n) for c, n in found.items()]
            yield pd.DataFrame(rows, columns=[key, "category", "hits", "negated"])

    kind = passages.schema[key].dataType.simpleString()
    return passages.select(key, text).mapInPandas(run, f"{key} {kind}, category string, hits long, negated long")


#: Words of a lexicon up to which it goes to the tasks as one map; a larger one is joined.
IN_ROW = 10_000


def word_hits(passages: DataFrame, key: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """(key, category, hits) for single words of a lexicon (term, category).

    A lexicon of up to IN_ROW words filters the tokens where they are, so only hits are exploded; a larger one meets the
    words of each passage in an equi-join. A word in several categories counts in each.
    """
    few = lexicon.select("term", "category").distinct().limit(IN_ROW + 1).collect()
    if len(few) > IN_ROW:
        words = passages.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
        return words.join(lexicon.distinct(), "term").groupBy(key, "category").agg(F.sum("n").alias("hits"))
    by: dict[str, list[str]] = {}
    for term, category in few:
        by.setdefault(term, []).append(category)
    if not by:
        return passages.select(key, F.lit("").alias("category"), F.lit(0).cast("long").alias("hits")).limit(0)
    known = F.array(*[F.lit(w) for w in by])
    categories = F.array(*[F.array(*[F.lit(c) for c in sorted(cs)]) for cs in by.values()])
    place = F.transform(F.filter(tokens, lambda w: w.isin(*by)), lambda w: F.array_position(known, w).cast("int"))
    hits = passages.select(key, F.explode(place).alias("p"))
    return hits.select(key, F.explode(F.element_at(categories, F.col("p"))).alias("category")).groupBy(key, "category").agg(F.count("*").alias("hits"))


def rates(hits: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Hits and rate per thousand words of each category, 0 hits where a text has words but none of them."""
    return hits.join(words, key).withColumn("rate", N.rate_per(F.col("hits"), F.col("words")))


def net_tone(positive: Column, negative: Column) -> Column:
    """Positive less negative rate; null if either is."""
    return positive - negative


def expanded_terms(terms: DataFrame) -> DataFrame:
    """Terms (term, category) with their plural and spelling forms, each once."""
    more = terms.select(F.explode(T.expanded(F.col("term"))).alias("term"), "category")
    return terms.select("term", "category").unionByName(more).distinct()


def wide_to_long(df: DataFrame, word: str, categories: list[str]) -> DataFrame:
    """Dictionary rows with a column a category, where a number other than 0 means membership, as (term, category)."""
    long = df.unpivot([word], [F.col(c).cast("string").alias(c) for c in categories], "category", "v").where(F.coalesce(F.expr("try_cast(v as double)"), F.lit(0.0)).cast("int") != 0)
    return long.select(F.array_join(T.tokens(F.col(word)), " ").alias("term"), F.lower("category").alias("category")).where("term <> ''").distinct()
