"""Keyword search over tokens: parsed queries, matching, ranks and term coverage."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


@dataclass(frozen=True)
class Parsed:
    """Alternatives of terms that must all occur, phrases among them, and terms that must not."""

    groups: tuple[tuple[str, ...], ...] = field(default_factory=tuple)
    without: tuple[str, ...] = ()


def parsed(query: str) -> Parsed:
    """Words all count, "phrases" stay together, OR parts alternatives, a leading minus excludes."""
    groups: list[list[str]] = [[]]
    without = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        term = " ".join((phrase or word).lower().split())
        if word == "OR":
            groups.append([])
        elif minus:
            without.append(term)
        elif term:
            groups[-1].append(term)
    return Parsed(tuple(tuple(g) for g in groups if g), tuple(without))


def occurrences(tokens: Column, term: str) -> Column:
    """How often a term occurs; words of a phrase in a row."""
    words = term.split()
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda x: x == words[0]))
    return F.size(F.filter(T.shingles(tokens, len(words)), lambda x: x == term))


def keyword_search(docs: DataFrame, key: str, text: str, query: Parsed, most: int) -> DataFrame:
    """(key, score, rank) of the documents that match, best first; the score is damped by the document's length.

    A text without the characters of the words that must occur isn't tokenised.
    """
    low = F.lower(text)
    may = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for x in g for w in x.split()], F.lit(True)) for g in query.groups], F.lit(False))
    tk = docs.where(may).select(key, T.tokens(F.col(text)).alias("tk"))
    names = {t: f"_t{i}" for i, t in enumerate(dict.fromkeys([x for g in query.groups for x in g] + list(query.without)))}
    counted = tk.select(key, F.size("tk").alias("n"), *[occurrences(F.col("tk"), t).alias(c) for t, c in names.items()])
    group = F.lit(False)
    for g in query.groups:
        every = F.lit(True)
        for x in g:
            every = every & (F.col(names[x]) > 0)
        group = group | every
    for x in query.without:
        group = group & (F.col(names[x]) == 0)
    terms = dict.fromkeys(x for g in query.groups for x in g)
    score = sum((F.log(1.0 + F.col(names[x])) for x in terms), F.lit(0.0)) / F.log(2.0 + F.col("n"))
    best = counted.where(group).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def covering(queries: DataFrame, query_key: str, terms: str, docs: DataFrame, key: str, tokens: str, most: int) -> DataFrame:
    """(query_key, key, coverage): the documents with most of a query's terms. Only shared terms meet; terms goes broadcast if small."""
    q = queries.select(query_key, F.size(terms).alias("_n"), F.explode(terms).alias("term"))
    d = docs.select(key, F.explode(tokens).alias("term"))
    hits = q.join(d, "term").groupBy(query_key, key).agg(F.count("*").alias("_hits"), F.first("_n").alias("_n"))
    n = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("_hits"), key))
    return hits.withColumn("_rank", n).where(F.col("_rank") <= most).select(query_key, key, (F.col("_hits") / F.col("_n")).alias("coverage"))
