"""Near-duplicate passages by compact windows.

A token is a 5-word shingle at its place in a text; a passage of 50 words has 46. For each of HASHES hash functions the
Cartesian tree over the tokens' hashes of a text gives its compact windows (l, c, r): every subsequence within [l, r]
that holds c has its minimum at c. Only windows that are at least a passage wide are kept, about two for every 46
tokens. Windows with equal minimum, from any of the functions, are joined; around the shared token the intervals are laid
on each other and verified: a passage of 46 tokens around c, of which at least 41 agree, has a similarity of 41 / 51 or
more. An exact passage of 50 words has the same minimum wherever it stands, so it is found by any one function. Two
passages whose tokens have similarity s share none of the HASHES minima with chance (1 - s) ** HASHES, 4 % at 0.8, less
for longer ones. Of 1,500 copies of one passage of 56 words, each with a word changed anywhere, 1,447 were found, of 300
copies of two others all.

Equal windows of a group collapse to one, which is a passage as a whole if several documents hold it. The distinct ones
are compared each with every other, and a span is the union of what a window shares with any window of another document.
Groups of more than GROUP windows, such as a passage in a third of all texts, are compared in blocks of about GROUP
distinct windows, each block with every other, so the size of a group changes no result.

Null and empty texts and texts of fewer than 50 words have no passages; null doc_ids take no part. Repetition within one
document doesn't count. Rows that repeat a doc_id are one document. No passage is dropped however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_ROWS, by_group, components, discard, lean, small_side, written
from .kernels import U, pieces, shingle_at, splitmix, stream, text_buffers, words

#: Hash functions; words of a passage; its tokens; tokens that must agree.
HASHES, WORDS = 2, 50
TOKENS = WORDS - 4
AGREE = int(np.ceil(2 * TOKENS * 0.8 / 1.8))
#: Windows of a group up to which one task compares them; distinct windows in a block of a larger one.
GROUP = 1024
#: Tasks at most that pairs of blocks are dealt to.
MOST_PARTS = 4000
SIDE = TOKENS - 1
_PLACE = U((1 << 28) - 1)
_SEEDS = stream(51, HASHES)


def cartesian(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value to the left (-1) and to the right (n) of each; of equal ones the first is smaller."""
    n = len(values)
    left, right = np.full(n, -1), np.full(n, n)
    stack: list[int] = []
    plain = values.tolist()
    for i, v in enumerate(plain):
        while stack and plain[stack[-1]] > v:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    return left, right


def compact_windows(grams: np.ndarray, first: np.ndarray, last: np.ndarray, seed: np.uint64, width: int = TOKENS) -> tuple[np.ndarray, ...]:
    """(value, text, l, c, r) of the windows at least width wide, positions within their texts.

    grams: tokens of several texts in a row; first, last: where each text's tokens begin and end.
    """
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    n = len(grams)
    if n < width:
        return none
    h = splitmix(grams ^ seed)
    low = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - width + 1], low[width - size :][: n - width + 1])
    starts = np.arange(n - width + 1)
    text = np.searchsorted(first, starts, "right") - 1
    inside = (text >= 0) & (starts + width <= last[text])
    starts, text, at = starts[inside], text[inside], (low[inside] & _PLACE).astype(np.int64)
    if not len(starts):
        return none
    run = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    c, owner = at[run], text[run]
    begin, end = starts[run], starts[np.append(run[1:], len(starts)) - 1] + width
    # a minimum that holds for a whole width to one side reaches on to the next smaller one
    value = (h[c] & ~_PLACE) | c.astype(np.uint64)
    left, right = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
    for k in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [k, k + 1])
        lo, hi = cartesian(value[a:b])
        left[a:b] = np.where(lo < 0, first[k], c[a:b][np.maximum(lo, 0)] + 1)
        right[a:b] = np.where(hi >= b - a, last[k], c[a:b][np.minimum(hi, b - a - 1)])
    l = np.where(begin == c - width + 1, np.minimum(left, begin), begin)
    r = np.where(end == c + width, np.maximum(right, end), end)
    return h[c], owner, l - first[owner], c - first[owner], r - 1 - first[owner]


def _token_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, tokens, begin and end of each text's tokens) by piece."""
    offsets, data = text_buffers(column)
    for a, b in pieces(offsets):
        h, at, _, _ = words(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        yield a, shingle_at(h), at[:-1], np.maximum(at[:-1], at[1:] - 4)


def windows(docs: DataFrame) -> DataFrame:
    """(value, doc_id, place, n_left, n_right): the compact windows of each text; place is c, the rest its reach, up to SIDE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, grams, first, last in _token_runs(batch.column(1)):
                for seed in _SEEDS:
                    value, text, l, c, r = compact_windows(grams, first, last, seed)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[a + text]), pa.array(c.astype(np.int32)), pa.array(np.minimum(c - l, SIDE).astype(np.int16)), pa.array(np.minimum(r - c, SIDE).astype(np.int16))], ["value", "doc_id", "place", "n_left", "n_right"])

    return docs.mapInArrow(lean(run), "value long, doc_id long, place int, n_left short, n_right short")


class _Seen:
    """Which keys a task has met of late: a table that forgets by overwriting, so never too small an answer is given."""

    def __init__(self, bits: int = 18) -> None:
        self.keys, self.mask = np.zeros(1 << bits, np.uint64), U((1 << bits) - 1)

    def new(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & self.mask).astype(np.int64)
        out = self.keys[slot] != keys
        _, first = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), bool)
        once[first] = True
        out &= once
        self.keys[slot[out]] = keys[out]
        return out


_WEIGHTS = stream(52, 2 * TOKENS - 1) | U(1)


def _hits_of(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """(text of each hit, then its fields) of a column of lists of hits."""
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), *(flat.field(i).to_numpy() for i in range(5))


def _around(hits: DataFrame) -> DataFrame:
    """The hits of each document with the tokens of their interval [l, r], up to SIDE on either side of the shared one.

    key stands for these tokens and their place in the window; a task leaves the tokens out where it gave them before.
    """
    names = ["value", "n", "doc_id", "place", "key", "around", "from_", "to_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.arange(-SIDE, SIDE + 1)
        seen = _Seen()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column(0).to_numpy()
                text, values, counts, places, left, right = _hits_of(part.column(2))
                for a, grams, first, last in _token_runs(part.column(1)):
                    lo, hi = np.searchsorted(text, [a, a + len(first)])
                    for b in range(int(lo), int(hi), 4096):
                        mine = slice(b, min(b + 4096, int(hi)))
                        k = text[mine] - a
                        c = first[k] + places[mine]
                        ok = c < last[k]
                        if len(grams):
                            token = grams[np.minimum(c, len(grams) - 1)]
                            # another text of a repeated id may stand at the same place
                            ok &= np.any([splitmix(token ^ s).view(np.int64) == values[mine] for s in _SEEDS], axis=0)
                        if not ok.any():
                            continue
                        k, c, own = k[ok], c[ok], values[mine][ok]
                        before = np.minimum(left[mine][ok], c - first[k]).astype(np.int64)
                        after = np.minimum(right[mine][ok], last[k] - 1 - c).astype(np.int64)
                        there = (span >= -before[:, None]) & (span <= after[:, None])
                        near = np.where(there, (grams[np.clip(c[:, None] + span, 0, len(grams) - 1)] >> U(48)).astype(np.uint16), np.uint16(0))
                        key = splitmix((near * _WEIGHTS).sum(axis=1, dtype=np.uint64) + U(128) * before.astype(np.uint64) + after.astype(np.uint64))
                        fresh = seen.new(splitmix(key ^ own.view(np.uint64)))
                        size = np.where(fresh, near.shape[1] * 2, 0)
                        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                        around = pa.Array.from_buffers(pa.binary(), len(k), [pa.py_buffer(np.packbits(fresh, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(near[fresh].tobytes())])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own), pa.array(counts[mine][ok]), pa.array(ids[a + k]), pa.array((c - first[k]).astype(np.int32)), pa.array(key.view(np.int64)), around, pa.array((SIDE - before).astype(np.int16)), pa.array((SIDE + after + 1).astype(np.int16))], names
                        )

    return hits.mapInArrow(lean(run), "value long, n long, doc_id long, place int, key long, around binary, from_ short, to_ short")


def _agreement(own: np.ndarray, there: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked, start, stop, tokens that agree) of rows of own against rows of other, place by place."""
    same = (own == other) & there
    agree = np.count_nonzero(same, axis=1)
    linked, start, stop = np.zeros(len(own), bool), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    maybe = np.flatnonzero(agree >= AGREE)
    if len(maybe):
        some = same[maybe]
        total = np.zeros((len(maybe), own.shape[1] + 1), np.int16)
        np.cumsum(some, axis=1, dtype=np.int16, out=total[:, 1:])
        good = total[:, TOKENS:] - total[:, :-TOKENS] >= AGREE
        linked[maybe] = good.any(axis=1)
        first, last = good.argmax(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1)
        span = np.arange(own.shape[1])
        inside = some & (span >= first[:, None]) & (span < last[:, None] + TOKENS)
        start[maybe], stop[maybe] = inside.argmax(axis=1), own.shape[1] - inside[:, ::-1].argmax(axis=1)
    return linked, start, stop, agree


#: Tokens that agree in place if the shared token stands in the longer part of a passage with a gap.
BESIDE = (AGREE - 1) // 2
#: Words more or fewer up to which 46 tokens can still agree in 41 of 51; more lower the similarity under the bound.
SHIFTS = (-2, -1, 1, 2)


def _shifted(own: np.ndarray, there: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, start, stop) of the stretches of each row of own whose tokens agree in place or at one shift with other's."""
    n, width = own.shape
    found, start, stop = np.zeros(n, bool), np.full(n, width), np.zeros(n, np.int64)
    same = (own == other) & there
    for s in SHIFTS:
        both = same.copy()
        if s > 0:
            both[:, :-s] |= (own[:, :-s] == other[:, s:]) & there[:, :-s]
        else:
            both[:, -s:] |= (own[:, -s:] == other[:, :s]) & there[:, -s:]
        maybe = np.flatnonzero(np.count_nonzero(both, axis=1) >= AGREE)
        if not len(maybe):
            continue
        total = np.zeros((len(maybe), width + 1), np.int16)
        np.cumsum(both[maybe], axis=1, dtype=np.int16, out=total[:, 1:])
        good = total[:, TOKENS:] - total[:, :-TOKENS] >= AGREE
        some = good.any(axis=1)
        hit = maybe[some]
        if len(hit):
            good = good[some]
            found[hit] = True
            first, last = good.argmax(axis=1), good.shape[1] - good[:, ::-1].argmax(axis=1)
            start[hit], stop[hit] = np.minimum(start[hit], first), np.maximum(stop[hit], last + TOKENS - 1)
    return found, start, stop


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches over the edges (a, b)."""
    label = np.arange(n) if label is None else label
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


@dataclass
class Rows:
    """Distinct windows: their tokens, which of them lie in the window, and the document if only one has it, else -1 - row."""

    around: np.ndarray
    there: np.ndarray
    who: np.ndarray

    def __post_init__(self) -> None:
        # what several documents hold is a passage as a whole, if it is long enough
        width = self.around.shape[1]
        self.first, self.last = self.there.argmax(axis=1), width - self.there[:, ::-1].argmax(axis=1)
        alone = (self.who >= 0) | (self.last - self.first < TOKENS)
        self.start, self.stop = np.where(alone, width, self.first), np.where(alone, 0, self.last)
        self.label = np.arange(len(self.who))

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Widen the spans of both sides by what each pair of rows (left, right) shares, and join the labels of linked ones."""
        other = self.who[left] != self.who[right]
        left, right = left[other], right[other]
        edges, apart = [], []
        for i in range(0, len(left), 4096):
            x, y = left[i : i + 4096], right[i : i + 4096]
            hit, s, e, same = _agreement(self.around[x], self.there[x] & self.there[y], self.around[y])
            for side in (x[hit], y[hit]):
                np.minimum.at(self.start, side, s[hit])
                np.maximum.at(self.stop, side, e[hit])
            edges.append(i + np.flatnonzero(hit))
            apart.append(i + np.flatnonzero(~hit & (same >= BESIDE)))
        if not edges:
            return
        linked, later = np.concatenate(edges), np.concatenate(apart)
        self.label = _labels(len(self.who), left[linked], right[linked], self.label)
        more = []
        for i in range(0, len(later), 4096):
            # a shift changes nothing between windows of one class that are shared from end to end
            k = later[i : i + 4096]
            full = (self.start <= self.first) & (self.stop >= self.last)
            k = k[~(full[left[k]] & full[right[k]] & (self.label[left[k]] == self.label[right[k]]))]
            if not len(k):
                continue
            x, y = left[k], right[k]
            hit, s, e = _shifted(self.around[x], self.there[x], self.around[y])
            k, x, y, s, e = k[hit], x[hit], y[hit], s[hit], e[hit]
            if len(k):
                back, s2, e2 = _shifted(self.around[y], self.there[y], self.around[x])
                for side, a, b in ((x[back], s[back], e[back]), (y[back], s2[back], e2[back])):
                    np.minimum.at(self.start, side, a)
                    np.maximum.at(self.stop, side, b)
                more.append(k[back])
        if more:
            joined = np.concatenate(more)
            self.label = _labels(len(self.who), left[joined], right[joined], self.label)


def _tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens around the shared one, whether each lies in the window) of the rows of a table."""
    around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint16).reshape(table.num_rows, -1)
    span = np.arange(around.shape[1])
    lo, hi = (table.column(c).combine_chunks().to_numpy()[:, None] for c in ("from_", "to_"))
    return around, (span >= lo) & (span < hi)


def _every_pair(end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with i < j < end of i's group."""
    rows = np.arange(len(end))
    ahead = end - rows - 1
    left = np.repeat(rows, ahead)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(ahead) - ahead, ahead)


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of whole groups: each distinct window against every other one of its group."""
    value = table.column("value").combine_chunks().to_numpy()
    ids = table.column("doc_id").combine_chunks().to_numpy()
    place = table.column("place").combine_chunks().to_numpy().astype(np.int64)
    key = table.column("key").combine_chunks().to_numpy()
    # of equal windows one that brings its tokens comes first
    order = np.lexsort((table.column("around").combine_chunks().is_null().to_numpy(zero_copy_only=False), key, value))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (value[order][1:] != value[order][:-1]))
    mine = np.empty(len(ids), np.int64)
    mine[order] = np.cumsum(new) - 1
    one = order[new]
    around, there = _tokens_of(table.select(["around", "from_", "to_"]).take(pa.array(one)))
    least, most = ids[one].copy(), ids[one].copy()
    np.minimum.at(least, mine, ids)
    np.maximum.at(most, mine, ids)
    rows = Rows(around, there, np.where(least < most, -1 - np.arange(len(one)), _numbered(least)))
    cut = np.flatnonzero(np.diff(value[one], prepend=~value[one[0]], append=~value[one[-1]]))
    rows.compare(*_every_pair(np.repeat(cut[1:], np.diff(cut))))
    np.minimum.at(least, rows.label, least)
    out = np.flatnonzero(rows.stop[mine] > 0)
    if len(out):
        shift, k = place[out] - SIDE, mine[out]
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(shift + rows.start[k]), pa.array(shift + rows.stop[k]), pa.array(least[rows.label[k]])], ["doc_id", "start", "stop", "rep"])


def _numbered(ids: np.ndarray) -> np.ndarray:
    """Numbers from 0 on that are equal where ids are."""
    return np.unique(ids, return_inverse=True)[1]


def _block_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans and links of the distinct windows of two blocks of a large group, or of one with itself."""
    pair = table.column("pair").combine_chunks().to_numpy()
    cut = np.flatnonzero(np.diff(pair, prepend=~pair[0], append=~pair[-1]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = table.slice(a, b - a)
        ids, least, most = (part.column(c).combine_chunks().to_numpy() for c in ("id", "least", "most"))
        rows = Rows(*_tokens_of(part), np.where(least < most, -1 - np.arange(len(ids)), _numbered(least)))
        if part.column("diagonal")[0].as_py():
            rows.compare(*_every_pair(np.full(len(ids), len(ids))))
        else:
            side = part.column("right").combine_chunks().to_numpy(zero_copy_only=False)
            x, y = np.flatnonzero(~side), np.flatnonzero(side)
            rows.compare(np.repeat(x, len(y)), np.tile(y, len(x)))
        out = np.flatnonzero(rows.stop > 0)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(rows.start[out].astype(np.int32)), pa.array(rows.stop[out].astype(np.int32)), pa.array(ids[rows.label[out]])], ["id", "start", "stop", "root"])


def _in_blocks(large: DataFrame) -> DataFrame:
    """Spans of windows in large groups: distinct windows in blocks, each block with every other one of its group."""
    own = F.xxhash64("value", "key").alias("id")
    body = [F.first(c, ignorenulls=True).alias(c) for c in ("around", "from_", "to_")]
    reps = written(large.groupBy("value", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *body).withColumn("id", own), "reps")
    blocks = written(reps.groupBy("value").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")), "blocks")
    pairs = blocks.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    blocks = small_side(blocks)
    dealt = reps.join(blocks, "value").withColumn("block", F.pmod("id", "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("value", F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    dealt = dealt.select(pair, (F.col("block") == F.col("other")).alias("diagonal"), (F.col("block") > F.col("other")).alias("right"), "id", "least", "most", "around", "from_", "to_")
    found = by_group(dealt, "pair", _block_pairs, "id long, start int, stop int, root long", rows=2048, order=("id",), parts=int(min(MOST_PARTS, max(1, pairs))))
    # many short tasks, but few files: on a local disk Hadoop starts three processes for each file that an executor writes
    found = written(found.repartition(int(max(1, min(MOST_PARTS, -(-pairs * 2 * GROUP // PART_ROWS))))), "found")
    label = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "classes").withColumnRenamed("component", "class")
    named = written(reps.select("id", "least").join(label, "id", "left").withColumn("class", F.coalesce("class", "id")), "named")
    rep = named.groupBy("class").agg(F.min("least").alias("rep"))
    span = found.groupBy("id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    known = written(named.join(span, "id").join(rep, "class").select("id", "start", "stop", "rep"), "known")
    shift = F.col("place").cast("long") - SIDE
    return large.select(own, "doc_id", "place").join(small_side(known), "id").select("doc_id", (shift + F.col("start")).alias("start"), (shift + F.col("stop")).alias("stop"), "rep")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, rep_doc_id): the passages of each document that stand in another one too.

    Overlapping finds are one passage; rep_doc_id is the smallest document of the groups that it was found in, which is
    the document itself for the representatives.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    every = written(windows(docs), "windows")
    common = written(every.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "common")
    hits = every.join(common, "value").groupBy("doc_id").agg(F.collect_list(F.struct("value", "n", "place", "n_left", "n_right")).alias("hits"))
    hits = written(hits, "hits")
    discard(every, common)
    found = docs.join(hits, "doc_id").select("doc_id", "text", "hits")
    near = written(_around(found), "around")
    discard(hits)
    small = by_group(near.where(F.col("n") <= GROUP), "value", _compared, "doc_id long, start long, stop long, rep long", rows=2048, order=("doc_id", "place"))
    large = near.where(F.col("n") > GROUP)
    spans = small if large.isEmpty() else small.unionByName(_in_blocks(large))
    spans = written(spans.groupBy("doc_id", "start").agg(F.max("stop").alias("stop"), F.min("rep").alias("rep")), "spans")
    discard(near)
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    apart = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(F.col("apart").cast("int")).over(order)
    merged = spans.withColumn("apart", apart).withColumn("island", island).groupBy("doc_id", "island")
    merged = merged.agg(F.min("start").alias("first_word"), (F.max("stop") - F.min("start") + 4).alias("n_words"), F.min("rep").alias("rep_doc_id"))
    return merged.select("doc_id", F.col("first_word").cast("int").alias("first_word"), F.col("n_words").cast("int").alias("n_words"), "rep_doc_id")
