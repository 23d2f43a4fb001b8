"""Main text of web pages by equivalence classes of template tokens.

Every page becomes tokens in page order: opening tags with the path of elements above them, and digests of its texts.
Tokens of a host whose occurrence vectors over its pages are equal form an equivalence class; equal vectors are found by
one pre-aggregated sum of hashes a token, so no page set of a host is ever gathered. Classes on enough pages are tested
over the occurrence positions on every page: of two tokens that don't keep their order in every round of the class one
goes, and of two classes whose rounds cross, so that neither lies in one slot of the other, the smaller one goes. What is
left is the host's template, and its texts are left out of every page. Within article-like elements that takes a text on
all of FULL or more different pages, since short hosts may repeat a passage by chance; elsewhere a share of SUPPORT.

The remaining texts are in slots. On a page with article-like elements these hold the main text; on others all slots do
but those whose text is mostly links over the host's pages. Elements that are menus, headers or footers of the page,
sidebars, forms, scripts or styles by name hold no main text wherever they stand, nor do notices, adverts, comments and
the like by role, class or id if every word of the name says so: `cookie-notice` is one, `notice-of-meeting` isn't.

Pages of a host with equal html count as one, so neither copies of a page nor repeated rows make its text a template; all
rows are extracted each. Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line feed. Nothing else is dropped.

Null or empty html has the empty text. A null url has the empty host. Malformed markup is read tolerantly: elements left
open end with their parent, an unclosed comment or script ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, lean, small_side, written

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
OUTSIDE = frozenset("head nav footer aside form menu button select script style textarea noscript template iframe svg dialog title option object canvas xmp noframes".split())
MAIN = frozenset("article main".split())
# Words of class, id and role that mark parts which are no main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar rail aside complementary contentinfo comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations widget widgets toolbar pagination pager login search skip paywall".split())
# Words beside them that only tell place or shape.
LAYOUT = frozenset("area bar block body bottom box btn button buttons col column container content div footer form global group header icon icons inner item items left link links list main outer page panel posts reader readers right row section site slot stories story text title top unit user users wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
#: Share of a host's pages that a class needs; as each of its tokens stands on that share of pages, a host has at most
#: 1 / SUPPORT times the tokens of its mean page. The same of slots, and different pages that a text in articles needs.
SUPPORT, SLOT, FULL = 0.3, 0.02, 8
#: Hosts whose templates are broadcast, a few hundred numbers each; of more hosts they are shuffled to the pages.
HOSTS = 5_000
#: Classes that a task keeps the evidence of before it hands it on.
HELD = 20_000


@dataclass(slots=True)
class Piece:
    """A run of text with the path over it; path_id ends with the open elements' names and classes."""

    text: str
    path: str
    outside: bool
    main: bool
    linked: bool


def says_so(name: str) -> bool:
    """Whether a class or id means a part without main text: marks and words of place or shape, nothing else."""
    words = {w.lower() for w in _WORD.findall(name)}
    return bool(words & MARKS) and all(w in MARKS or w in LAYOUT or w.isdigit() for w in words)


def _marks(name: str, attributes: str) -> tuple[bool, bool, str]:
    """(holds no main text, article-like, label of the element in paths)."""
    outside, main, label = name in OUTSIDE, name in MAIN, name
    if attributes and "=" in attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value, key = a or b or c, key.lower()
            plain = name not in ("html", "body", "article", "main")
            if key in ("role", "itemprop"):
                main |= value.strip().lower() in ("main", "article", "articlebody")
                outside |= plain and key == "role" and value.strip().lower() in MARKS
            else:
                outside |= plain and any(map(says_so, value.split()))
            if key == "class":
                label += "." + _DIGITS.sub("#", ".".join(value.split()))
    return outside, main, label


def parsed(html: str) -> list[str | list[Piece]]:
    """Paths of the opened elements and blocks of text pieces, in page order."""
    out: list[str | list[Piece]] = []
    block: list[Piece] = []
    stack: list[tuple[str, bool, bool, bool, str]] = []  # name, outside, main, linked, path
    at, n = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            top = stack[-1] if stack else ("", False, False, False, "")
            block.append(Piece(raw, top[4], top[1], top[2], top[3]))

    def break_block() -> None:
        nonlocal block
        if block:
            out.append(block)
            block = []

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                break_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("html", "body", "main", "article", "div", "section"):
                    break
            continue
        if name in BLOCK:
            break_block()
            # a block ends an open paragraph, an item ends the item before it
            ends = {"p"} if name not in ("li", "dd", "dt", "tr", "td", "th", "option") else {"p", name, *(("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th", "tr") else ())}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        outside, main, label = _marks(name, m[3])
        above = stack[-1] if stack else ("", False, False, False, "")
        if name == "header" and not above[2]:
            outside = True
        path = f"{above[4]}/{label}"
        out.append(path)
        if name in VOID or m[3].rstrip().endswith("/"):
            if name == "br" or name == "wbr":
                text(" " if name == "br" else "")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append((name, above[1] or outside, above[2] or main, above[3] or name == "a", path))
    break_block()
    return out


def joined(block: list[Piece]) -> str:
    return " ".join(unescape("".join(p.text for p in block)).split())


def number(token: str) -> int:
    """What stands for a path or a text of any length."""
    return int.from_bytes(blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Page:
    """The tokens of a page in order, and its lines: the texts that may be main ones with their tokens and slots."""

    tokens: list[int] = field(default_factory=list)
    lines: list[tuple[str, int, int, int]] = field(default_factory=list)  # text, token, slot, characters in links
    has_main: bool = False


def read(html: str | None, numbered: dict[str, int] | None = None) -> Page:
    """numbered: paths that are known already."""
    known: dict[str, int] = {} if numbered is None else numbered
    parts = parsed(html or "")
    page = Page(has_main=any(p.main and not p.outside for b in parts if not isinstance(b, str) for p in b))

    def of(path: str) -> int:
        if path not in known:
            known[path] = number(path)
        return known[path]

    for part in parts:
        if isinstance(part, str):
            page.tokens.append(of(part))
            continue
        kept = [p for p in part if not p.outside and (p.main or not page.has_main)]
        if kept and (line := joined(kept)):
            token = number(("article " if page.has_main else "text ") + line)
            page.tokens.append(token)
            page.lines.append((line, token, of(kept[0].path), sum(len(p.text) for p in kept if p.linked)))
    return page


def extracted(html: str | None, template: frozenset[int] = frozenset(), links: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the tokens of its host's template and the slots of links."""
    page = read(html)
    if not page.has_main:
        own: dict[int, int] = {}
        for line, _, slot, linked in page.lines:
            own[slot] = own.get(slot, 0) + 2 * linked - len(line)
        links = links | {slot for slot, more in own.items() if more > 0}
    return "\n".join(line for line, token, slot, _ in page.lines if token not in template and (page.has_main or slot not in links))


def host_of(url) -> object:
    """Host of a url without user, port and a leading www."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)", 1))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, n, inside): how often a page has a token, and whether it is a text in an article-like element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[tuple] = []
                numbered = {} if len(numbered) > 1 << 16 else numbered
                for host, page, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    read_ = read(html, numbered)
                    found: dict[int, int] = {}
                    for token in read_.tokens:
                        found[token] = found.get(token, 0) + 1
                    texts = {token for _, token, _, _ in read_.lines} if read_.has_main else set()
                    rows += [(host, page, token, n, token in texts) for token, n in found.items()]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "page", "token", "n", "inside"])

    return pages.select("host", "page", "html").mapInArrow(lean(run), "host long, page long, token long, n int, inside boolean")


def classes(pages: DataFrame) -> DataFrame:
    """(host, class array, token array): the tokens of each host's classes on enough pages.

    pages: (host, page, html), page being the same for equal html. Everything is added up before it is shuffled by host.
    """
    by_page = tokens(pages).groupBy("host", "token", "page").agg(F.max("n").alias("n"), F.bool_or("inside").alias("inside"))
    hashed = by_page.withColumn("h", F.xxhash64("page", "n"))
    low, high = (F.sum(F.shiftrightunsigned("h", k).bitwiseAND(0x7FFFFFFF)).alias(c) for k, c in ((0, "low"), (31, "high")))
    by_token = hashed.groupBy("host", "token").agg(low, high, F.count("*").alias("on"), F.bool_or("inside").alias("inside"))
    many = pages.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    enough = (F.col("on") >= 2) & (F.col("on") >= SUPPORT * F.col("pages")) & (~F.col("inside") | (F.col("on") == F.col("pages")) & (F.col("pages") >= FULL))
    held = by_token.join(many, "host").where(enough).select("host", F.struct(F.xxhash64("low", "high").alias("class"), "token").alias("t"))
    lists = held.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("host", F.col("t.class").alias("class"), F.col("t.token").alias("token"))


class Evidence:
    """What the pages of one host seen by a task say: the order of each class's tokens, classes that cross, text and links of slots."""

    def __init__(self, class_: list[int], token: list[int]) -> None:
        self.members: dict[int, list[int]] = {}
        for c, t in zip(class_, token, strict=True):
            self.members.setdefault(c, []).append(t)
        self.of = dict(zip(token, class_, strict=True))
        self.place = {t: i for m in self.members.values() for i, t in enumerate(m)}
        self.before = {c: np.zeros((len(m), len(m)), bool) for c, m in self.members.items()}
        self.known: dict[int, set[tuple[int, ...]]] = {c: set() for c in self.members}
        self.crossing: set[tuple[int, int]] = set()
        self.slots: dict[int, list[int]] = {}

    def add(self, page: Page) -> None:
        seen: dict[int, list[tuple[int, int]]] = {}
        for at, t in enumerate(page.tokens):
            if (c := self.of.get(t)) is not None:
                seen.setdefault(c, []).append((at, self.place[t]))
        rounds: list[tuple[int, int, int]] = []
        for c, found in seen.items():
            m = len(self.members[c])
            if m == 1:
                continue
            order = tuple(p for _, p in found)
            if order not in self.known[c]:
                if len(self.known[c]) < 64:
                    self.known[c].add(order)
                first = order[:m]
                if len(set(first)) == m and len(order) % m == 0 and order == first * (len(order) // m):
                    rank = np.argsort(first)
                    self.before[c] |= rank[:, None] < rank[None, :]
                else:
                    self.before[c][:] = True
            rounds += [(found[i][0], -found[min(i + m, len(found)) - 1][0], c) for i in range(0, len(found), m)]
        open_: list[tuple[int, int]] = []
        for start, end, c in sorted(rounds):
            while open_ and open_[-1][0] < start:
                open_.pop()
            self.crossing |= {(min(c, d), max(c, d)) for e, d in open_ if start <= e < -end and d != c}
            open_.append((-end, c))
            open_.sort(reverse=True)
        if not page.has_main:
            for line, _, slot, linked in page.lines:
                sums = self.slots.setdefault(slot, [0, 0, 0])
                sums[0] += len(line)
                sums[1] += linked
            for slot in {slot for _, _, slot, _ in page.lines}:
                self.slots[slot][2] += 1

    def rows(self, host: int) -> Iterator[tuple]:
        """(host, kind, a, b, tokens, before, numbers)."""
        for c, m in self.members.items():
            yield host, 0, c, 0, m, np.packbits(self.before[c]).tobytes(), []
        for a, b in self.crossing:
            yield host, 1, a, b, [], b"", []
        for slot, sums in self.slots.items():
            yield host, 2, slot, 0, [], b"", sums


_EVIDENCE = "host long, kind int, a long, b long, tokens array<long>, before binary, numbers array<long>"


def evidence(pages: DataFrame) -> DataFrame:
    """What each task's pages (host, html, class, token) say of their hosts' classes, added up."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
    names = ["host", "kind", "a", "b", "tokens", "before", "numbers"]

    def handed(of: dict[int, Evidence]) -> Iterator[pa.RecordBatch]:
        rows = [r for host, e in of.items() for r in e.rows(host)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, Evidence] = {}
        numbered: dict[str, int] = {}
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                numbered = {} if len(numbered) > 1 << 16 else numbered
                for host, html, class_, token in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if host not in of:
                        of[host] = Evidence(class_ or [], token or [])
                        size += 1 + len(of[host].members)
                    of[host].add(read(html, numbered))
                if size > HELD:
                    yield from handed(of)
                    of, size = {}, 0
        yield from handed(of)

    return pages.select("host", "html", "class", "token").mapInArrow(lean(run), _EVIDENCE)


def ordered(before: np.ndarray) -> np.ndarray:
    """Members of a class that keep their order: the one with most conflicts goes until there is none."""
    both = before & before.T
    kept = np.ones(len(both), bool)
    while len(both) and (n := both.sum(axis=1)).max() > 0:
        worst = int(n.argmax())
        kept[worst] = False
        both[worst] = both[:, worst] = False
    return np.flatnonzero(kept)


def _decided(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(host, template, links) of whole hosts from their evidence."""
    host = table.column("host").combine_chunks().to_numpy()
    cut = np.flatnonzero(np.diff(host, prepend=~host[0], append=~host[-1]))
    out = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        members: dict[int, list[int]] = {}
        before: dict[int, np.ndarray] = {}
        crossing: set[tuple[int, int]] = set()
        slots: dict[int, list[int]] = {}
        for r in table.slice(i, j - i).select(["kind", "a", "b", "tokens", "before", "numbers"]).to_pylist():
            a, m = r["a"], len(r["tokens"])
            if r["kind"] == 0:
                bits = np.unpackbits(np.frombuffer(r["before"], np.uint8), count=m * m).astype(bool).reshape(m, m)
                members[a], before[a] = r["tokens"], before[a] | bits if a in before else bits
            elif r["kind"] == 1:
                crossing.add((a, r["b"]))
            else:
                slots[a] = [x + y for x, y in zip(slots.get(a, [0, 0, 0]), r["numbers"], strict=True)]
        valid = {c: [m[k] for k in ordered(before[c]).tolist()] for c, m in members.items()}
        for a, b in sorted(crossing, key=lambda x: (-len(valid.get(x[0], ())) - len(valid.get(x[1], ())), x)):
            if a in valid and b in valid:
                del valid[min((a, b), key=lambda c: (len(valid[c]), c))]
        most = max((n for _, _, n in slots.values()), default=0)
        links = [s for s, (chars, linked, n) in slots.items() if 2 * linked > chars and n >= max(2, SLOT * most)]
        out.append((int(host[i]), sorted(t for m in valid.values() for t in m), sorted(links)))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["host", "template", "links"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", F.xxhash64(host_of(F.col("url"))))
    found = written(classes(rows.select("host", F.xxhash64("html").alias("page"), "html")), "classes")
    seen = evidence(rows.join(small_side(found, HOSTS), "host", "left"))
    known = written(by_group(seen, "host", _decided, "host long, template array<long>, links array<long>", rows=512), "templates")
    rows = rows.join(small_side(known, HOSTS), "host", "left").select("page_id", "url", "html", "template", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for html, *tokens_ in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True):
                    keys = [tuple(t or ()) for t in tokens_]
                    for key in keys:
                        if key not in sets:
                            sets = {} if len(sets) > 256 else sets
                            sets[key] = frozenset(key)
                    out.append(extracted(html, *(sets[k] if k in sets else frozenset(k) for k in keys)))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(lean(run), "page_id long, url string, text string")
