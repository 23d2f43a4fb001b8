"""Benchmark decontamination by SimHash windows and a multi-index Hamming search.

For every item, windows of the item's size slide over the whole text. A window's SimHash is the sign of the summed votes
of its 5-word shingles. Items of one size are indexed by the blocks of their fingerprints: a fingerprint within RADIUS
of another agrees in at least one of BLOCKS blocks up to RADIUS // BLOCKS bits, so looking up the blocks finds all within
the radius. Exact weighted-shingle similarity (shared over united shingle counts) then decides.

Windows that can't reach the threshold are not fingerprinted, without loss: both sides have as many shingles as the
window at least, so threshold * shingles of them must occur in some item; prefix sums of that test decide it for each
window and size.

A text shorter than an item is one window. Items of fewer than five words are one shingle and match only themselves.
Null or empty texts and items match nothing. Repeated items and rows are reported each. Documents are read once for
ITEMS items, in further rounds beyond, which bounds what is broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .kernels import SHINGLE, U, pieces, shingle_at, short_shingle, text_buffers, words

#: Items of a round (each has a few kilobytes), bits of the radius, blocks of the 64 bits.
ITEMS, RADIUS, BLOCKS = 20_000, 23, 8
_BITS = 64 // BLOCKS


def item_shingles(text: str) -> tuple[int, np.ndarray]:
    """(words, shingle at each position) of an item."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    h, *_ = words(np.array([0, len(data)]), data)
    return len(h), shingle_at(h) if len(h) >= SHINGLE else short_shingle(h) if len(h) else np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    """64-bit SimHash of shingles, each counted as often as it occurs."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view("<u8")[0])


class HammingIndex:
    """All fingerprints within RADIUS of a given one, through equal or nearly equal blocks."""

    def __init__(self, prints: list[int]) -> None:
        self.prints = prints
        self.by: dict[tuple[int, int], set[int]] = defaultdict(set)
        masks = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(_BITS), n)]
        for i, p in enumerate(prints):
            for block in range(BLOCKS):
                own = p >> block * _BITS & (1 << _BITS) - 1
                for m in masks:
                    self.by[block, own ^ m].add(i)

    def near(self, p: int) -> list[int]:
        found: set[int] = set()
        for block in range(BLOCKS):
            found |= self.by.get((block, p >> block * _BITS & (1 << _BITS) - 1), set())
        return [i for i in found if (self.prints[i] ^ p).bit_count() <= RADIUS]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle sequences: minima over maxima of the counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Items:
    """Items of a round with their shingles, by size in words."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.of: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in rows:
            n, s = item_shingles(text)
            if n:
                self.of[n].append((item, s))
        self.index = {n: HammingIndex([fingerprint(s) for _, s in own]) for n, own in self.of.items()}
        every = [s for own in self.of.values() for _, s in own if len(s)]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.known >> U(42)).astype(np.int64)] = True

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = self.seen[(grams >> U(42)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        out[maybe] = self.known[at] == grams[maybe]
        return out

    def in_text(self, h: np.ndarray, grams: np.ndarray, hit: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item: (similarity, first word, words) of its best window. h: the text's words, grams and hit: its shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        total = np.append(0, np.cumsum(hit))
        for n, own in self.of.items():
            if n < SHINGLE:
                known = {int(s[0]): i for i, (_, s) in enumerate(own)}
                for at in range(len(h) - n + 1):
                    if (i := known.get(int(short_shingle(h[at : at + n])[0]))) is not None:
                        for item, s in own:
                            if s[0] == own[i][1][0]:
                                best.setdefault(item, (1.0, at, n))
                continue
            size = min(n, len(h)) - SHINGLE + 1
            if size < 1 or size < threshold * (n - SHINGLE + 1):
                continue
            inside = total[size:] - total[:-size]
            for at in np.flatnonzero(inside >= threshold * (n - SHINGLE + 1) - 1e-9).tolist():
                window = grams[at : at + size]
                for i in self.index[n].near(fingerprint(window)):
                    item, s = own[i]
                    if (sim := similarity(window, s)) >= threshold and sim > best.get(item, (0.0,))[0]:
                        best[item] = (sim, at, min(n, len(h)))
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each item that a document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for rows in _rounds(benchmark):
        found = _round(docs, rows, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _rounds(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in portions of about ITEMS."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rounds = -(-items.count() // ITEMS) or 1
    for r in range(rounds):
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        yield [(x["item_id"], x["text"]) for x in part.collect()]


def _texts(items: Items, column: pa.Array, threshold: float) -> Iterator[dict[int, tuple[float, int, int]]]:
    """What in_text finds in each text of column."""
    short = any(n < SHINGLE for n in items.of)
    offsets, data = text_buffers(column)
    for first, last in pieces(offsets):
        h, at, _, _ = words(offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]])
        grams = shingle_at(h)
        hit = items.has(grams) if len(items.known) else np.zeros(len(grams), bool)
        count = np.append(0, np.cumsum(hit))
        for k in range(last - first):
            a, b = int(at[k]), int(at[k + 1])
            c = max(a, b - SHINGLE + 1)
            some = b > a and (short or (c > a and count[c] > count[a]))
            yield items.in_text(h[a:b], grams[a:c], hit[a:c], threshold) if some else {}


def _round(docs: DataFrame, rows: list[tuple[int, str]], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in batches:
            out = [(doc, item, start, n, sim) for doc, found in zip(batch.column(0).to_pylist(), _texts(items, batch.column(1), threshold), strict=True) for item, (sim, start, n) in sorted(found.items())]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return docs.mapInArrow(lean(run), "doc_id long, item_id long, first_word int, n_words int, similarity double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that hold an item, in one pass and without a join; all columns stay."""
    for rows in _rounds(benchmark):
        docs = _without(docs, rows, threshold)
    return docs


def _without(docs: DataFrame, rows: list[tuple[int, str]], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not found for found in _texts(items, batch.column(place), threshold)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
