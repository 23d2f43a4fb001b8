"""Best-fit packing by minimum bin slack.

Documents become token sequences ended by id 0, cut only where longer than a sequence. What packing needs of them is
the histogram of piece lengths, at most `capacity` numbers, whatever the input. Over this histogram, sequence by
sequence: the longest remaining length is fixed and a bitset subset-sum dynamic program over the available lengths
finds the fullest feasible combination beside it; the combination is taken as often as the counts allow and removed.
Pieces are then dealt to the places of their length by rank, in salted groups, so no length is gathered in one task.

A null text is empty and becomes one piece with id 0 alone. Repeated rows are packed each. Null doc_ids are packed like
others. An empty table gives no rows. Texts are tokenised between white space through a bounded cache, which gives the
ids of the whole text, since the tokenizer's pattern never joins across white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written
from .kernels import U, pieces, text_buffers, words

#: Tokens of a sequence; id that ends a document; bits of the table of a worker's known words; pieces of a rank group.
CAPACITY, END, CACHE_BITS, RANKED = 2048, 0, 21, 512


class Known:
    """Open-addressed table from 64-bit hashes to numbers 0, 1, ...; whole arrays at a time."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.number = np.zeros(1 << bits, np.int32)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if it isn't there. Hash 0 counts as 1."""
        h = np.maximum(h, U(1))
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            there = self.keys[slot]
            hit = there == h
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            todo, h, slot = todo[on], h[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct hashes that aren't there in their order."""
        h = np.maximum(h, U(1))
        number = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            _, first = np.unique(slot, return_index=True)
            mine = np.zeros(len(h), bool)
            mine[first] = True
            mine &= free
            self.keys[slot[mine]], self.number[slot[mine]] = h[mine], number[mine]
            h, number, slot = h[~mine], number[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


def _loose_ends(part: np.ndarray) -> np.ndarray:
    """Where a lone mark behind a Latin letter starts a word of its own, as the tokenizer has it too."""
    out = np.zeros(len(part), bool)
    if len(part) > 2:
        letter = _LATIN[part]
        letter[1:] |= (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] != 0x97) & (part[1:] != 0xB7)
        out[1:-1] = _MARK[part[1:-1]] & letter[:-2] & _BLANK[part[2:]]
        out[-1] = False
    return out


_LATIN, _MARK, _BLANK = (np.zeros(256, bool) for _ in range(3))
_LATIN[0x61:0x7B] = True
_MARK[[ord(c) for c in ",.;:!?|"]] = True
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Encoder:
    """ids of texts by a tokenizers file that drops white space; each distinct word is encoded once for a while."""

    #: Stands between words that are encoded together; a word that holds it is encoded alone.
    BETWEEN = "\x01"

    def __init__(self, path: str, bits: int = CACHE_BITS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.bits = bits
        self.forget()

    def forget(self) -> None:
        self.known = Known(self.bits)
        self.start, self.size, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0

    def learn(self, h: np.ndarray, texts: list[str]) -> None:
        """Encode texts, distinct words with hashes h, many at once."""
        flat, sizes = [], []
        alone = [i for i, t in enumerate(texts) if self.BETWEEN in t]
        if alone:
            order = alone + sorted(set(range(len(texts))).difference(alone))
            h, texts = h[order], [texts[i] for i in order]
        for t in texts[: len(alone)]:
            flat.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(flat[-1])]))
        for at in range(len(alone), len(texts), 512):
            part = texts[at : at + 512]
            ids = np.array(self.tokenizer.encode(f" {self.BETWEEN} ".join(part), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.between)
            if len(cut) != len(part) - 1:
                raise ValueError("the tokenizer joins words across white space")
            flat.append(ids[ids != self.between])
            sizes.append(np.diff(cut - np.arange(len(cut)), prepend=0, append=len(flat[-1])))
        size = np.concatenate(sizes).astype(np.int32) if sizes else np.zeros(0, np.int32)
        n, total = self.known.size, int(size.sum())
        while len(self.size) < n + len(size):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while len(self.ids) < self.used + total:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.start[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        self.ids[self.used : self.used + total] = np.concatenate(flat) if flat else 0
        self.used += total
        self.known.add(h)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """ids of each text in order."""
        offsets, data = text_buffers(column)
        for a, b in pieces(offsets):
            raw = data[offsets[a] : offsets[b]]
            h, at, start, end = words(offsets[a : b + 1] - offsets[a], raw, _loose_ends)
            if self.known.size > 1 << self.bits - 1:
                self.forget()
            number = self.known.find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                fresh, where = np.unique(h[new], return_index=True)
                if self.known.size + len(fresh) > 3 << self.bits - 2:
                    self.forget()
                    fresh, where = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                    while len(fresh) > 3 << self.known.bits - 2:
                        self.known = Known(self.known.bits + 1)
                at_word = new[where]
                plain = raw.tobytes()
                self.learn(fresh, [plain[s:e].decode("utf-8", "replace") for s, e in zip(start[at_word].tolist(), end[at_word].tolist(), strict=True)])
                number = self.known.find(h)
            size = self.size[number]
            bound = np.append(0, np.cumsum(size))
            flat = self.ids[np.repeat(self.start[number] - bound[:-1], size) + np.arange(bound[-1])]
            for k in range(b - a):
                yield flat[bound[at[k]] : bound[at[k + 1]]]


def token_pieces(docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. path may be a function that finds the file where it is called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path() if callable(path) else path)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                out += [(doc, k, i, min(capacity, len(ids) - i), zlib.crc32(ids[i : i + capacity].tobytes())) for k, i in enumerate(range(0, len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, longest first and within counts, whose sum is the largest up to room. lengths: those of counts, descending."""
    if room <= 0:
        return []
    mask = (1 << (room + 1)) - 1
    goal = 1 << room
    sums, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        most = min(counts[length], room // length)
        size = 1
        while most > 0 and not sums & goal:
            take = min(size, most)
            more = (sums | sums << (take * length)) & mask
            if more == sums:
                break
            steps.append((sums, length, take))
            sums, most, size = more, most - take, size * 2
        if sums & goal:
            break
    best, out = sums.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            best -= take * length
            out += [length] * take
    return sorted(out, reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many sequences are like it) until every piece of the histogram is placed."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        combination = [first, *fullest(counts, lengths if counts[first] else lengths[1:], capacity - first)]
        counts[first] += 1
        used = {k: combination.count(k) for k in set(combination)}
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        lengths = [k for k in lengths if counts[k]]
        out.append((combination, times))
    return out


def packed(docs: DataFrame, path: str | Callable[[], str], capacity: int = CAPACITY) -> DataFrame:
    """The pieces of token_pieces with sequence_id and offset, at most capacity tokens a sequence and no gaps."""
    pieces = written(token_pieces(docs, path, capacity), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    keys, place, base = [], [], []
    total, ranks = 0, dict.fromkeys(histogram, 0)
    for combination, times in patterns(histogram, capacity):
        offset = 0
        for length in combination:
            keys.append((length, ranks[length])), place.append(offset), base.append(total - ranks[length])
            ranks[length] += times
            offset += length
        total += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    wide = 1 << 48
    bounds = np.array([keys[i][0] * wide + keys[i][1] for i in order], np.int64)
    places, bases = np.array([place[i] for i in order], np.int64), np.array([base[i] for i in order], np.int64)

    spark = pieces.sparkSession
    groups = spark.createDataFrame([(k, max(1, v // RANKED)) for k, v in histogram.items()] or [(1, 1)], "length long, groups long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups")))
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(bounds, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bases[at] + rank), pa.array(places[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
