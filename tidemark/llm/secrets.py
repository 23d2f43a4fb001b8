"""Secret scans behind a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The index
keeps, for each block of documents, the postings of the trigrams that the queries name; intersecting and uniting
postings gives each rule's candidates, and only these are verified by the regular expression. A rule without mandatory
trigrams scans every text. All of it is DataFrame functions.

Trigrams are taken in lower case from the whole text, so a candidate set is never too small; verification decides.
A null text counts as empty and has no spans. Documents with a null doc_id can't be found by postings and are verified
in full. Repeated doc_ids share their candidates, and each row is verified on its own text. Positions count code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, small_side, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds of the base contract, in its order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that are found besides.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_claims", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"://[^/\x20\x09-\x0D:@]{1,64}:[^/\x20\x09-\x0D:@]{4,64}@"),
)
RULES = BASE + MORE
#: Documents of a block of the index; bounds every postings list.
BLOCK = 4096
#: Strings of an alternation and members of a character class that are followed one by one.
FOLLOWED, MEMBERS = 64, 8

Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    """kind is and or or; True is a query that every text satisfies."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and True in parts:
        return True
    parts = [x for x in parts if x is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _grams(text: str) -> Query:
    return _both("and", [text[i : i + 3] for i in range(len(text) - 2)])


def _follow(parsed: list) -> tuple[set[str] | None, Query]:
    """(all strings that parsed can match or None, a query that its matches satisfy)."""
    open_strings: set[str] | None = {""}
    found: list[Query] = []

    def flush() -> None:
        found.append(_both("or", [_grams(s) for s in sorted(open_strings)]))

    exact = True
    for op, arg in parsed:
        strings: set[str] | None = None
        query: Query = True
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            members = {chr(x).lower() for k, v in arg if k in (C.LITERAL, C.RANGE) for x in ([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + 99) + 1))}
            plain = all(k in (C.LITERAL, C.RANGE) for k, _ in arg)
            strings = members if plain and len(members) <= MEMBERS else None
        elif op is C.SUBPATTERN:
            strings, query = _follow(arg[3])
        elif op is C.BRANCH:
            ways = [_follow(x) for x in arg[1]]
            strings = set().union(*[s for s, _ in ways]) if all(s is not None for s, _ in ways) else None
            query = _both("or", [q for _, q in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            some, inside = _follow(inner)
            if some is not None and int(high) == 1 and low == 0:
                strings = some | {""}
            elif some is not None and low == high and low * max(map(len, some), default=0) <= 8 and len(some) == 1:
                strings = {next(iter(some)) * low}
            query = inside if low else True
        if strings is not None and len(strings) * len(open_strings) <= FOLLOWED:
            open_strings = {a + b for a in open_strings for b in strings}
            continue
        exact = False
        flush()
        found.append(query)
        open_strings = {""}
    if exact:
        return open_strings, _both("or", [_grams(s) for s in sorted(open_strings)])
    flush()
    return None, _both("and", found)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams that every text with a match satisfies; True if none is mandatory."""
    return _follow(list(_parser.parse(re.sub(r"^\(\?i\)", "", pattern))))[1]


def _named(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_named, query[1:]))


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings by block: column g<i> has the doc_ids of the block's texts that hold grams[i].

    A block is a run of rows of one partition, so it is gathered before the shuffle.
    """
    low = F.lower("text")
    rows = docs.select(F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block"), "doc_id", *[low.contains(g).alias(f"h{i}") for i, g in enumerate(grams)])
    return rows.groupBy("block").agg(*[F.collect_list(F.when(F.col(f"h{i}"), F.col("doc_id"))).alias(f"g{i}") for i in range(len(grams))])


def candidates(postings: DataFrame, queries: dict[str, Query], grams: list[str]) -> DataFrame:
    """(doc_id, kinds array): the rules whose query the document's postings satisfy."""
    place = {g: i for i, g in enumerate(grams)}

    def ids(query: Query) -> Column:
        if isinstance(query, str):
            return F.col(f"g{place[query]}")
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(ids, query[1:]))

    def tag(kind: str):
        return lambda x: F.struct(x.alias("doc_id"), F.lit(kind).alias("kind"))

    tagged = [F.transform(F.array_distinct(ids(q)), tag(kind)) for kind, q in queries.items()]
    return postings.select(F.explode(F.concat(*tagged)).alias("c")).groupBy("c.doc_id").agg(F.collect_set("c.kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int, gaps: Column, matches: Column, groups: Column) -> Column:
    """array of (start, place, end) of the rule's accepted matches; gaps lie before, between and after the matches."""
    kind = "struct<pos:int,out:array<struct<start:int,place:int,end:int>>>"
    parts = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"), groups.alias("part"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,place:int,end:int>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"))
        taken = F.length(x["part"]) >= max(rule.least, 1)
        return F.struct(end.alias("pos"), F.when(taken, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(kind)

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with column spans: array of (start, place, end) sorted so; place indexes rules. docs has doc_id and text."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    if indexed:
        grams = sorted(set().union(*map(_named, indexed.values())))
        posted = index(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), grams)
        wanted = written(candidates(posted, indexed, grams).withColumnRenamed("doc_id", "_id"), "candidates")
        docs = docs.join(small_side(wanted), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        docs = docs.withColumn("kinds", F.lit(None).cast("array<string>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    for i, r in enumerate(rules):
        looks = F.lit(True) if r.kind not in indexed else F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        docs = docs.withColumn(f"_hit{i}", F.when(looks, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none))
    docs = docs.drop("kinds")
    for i, r in enumerate(rules):
        any_hit = F.size(f"_hit{i}") > 0
        docs = docs.withColumn(f"_gap{i}", F.when(any_hit, F.split(text, r.pattern, -1)).otherwise(none))
        if r.group:
            docs = docs.withColumn(f"_part{i}", F.when(any_hit, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))).otherwise(none))
    empty = F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = [F.when(F.size(f"_hit{i}") > 0, _spans(text, r, i, F.col(f"_gap{i}"), F.col(f"_hit{i}"), F.col(f"_part{i}" if r.group else f"_hit{i}"))).otherwise(empty) for i, r in enumerate(rules)]
    docs = docs.withColumn("spans", F.array_sort(F.concat(*each)))
    return docs.drop(*[f"_{k}{i}" for k in ("hit", "gap", "part") for i in range(len(rules))])


def named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every document."""
    return found(docs.select("doc_id", "text"), rules).select("doc_id", "spans")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs whose texts have mark in place of every secret, overlapping spans together; n_chars follows. No document goes."""
    docs, back = aside(docs, "doc_id", "text", "n_chars")
    out = found(docs, rules)
    kind = "struct<pos:int,text:string>"
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        more = F.when(s["start"] >= acc["pos"], F.concat(acc["text"], between, F.lit(mark))).otherwise(acc["text"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), more.alias("text")).cast(kind)

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    out = out.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(out)
