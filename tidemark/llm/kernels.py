"""Array kernels over Arrow string columns: words, word hashes and shingles without a Python object per word.

Words are the maximal runs outside the bytes 0x20 and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Text bytes that are turned into arrays at a time; an intermediate array is eight times as large.
PIECE = 1 << 18
SHINGLE = 5


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % 2**64))


_BYTE = stream(11, 256)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_POSITION = stream(12, SHINGLE) | U(1)
_powers = np.ones(64, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n or _powers[1] == 1:
        m = max(64, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, _BASE, np.uint64)]))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes add up to about limit; a longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(offsets: np.ndarray, data: np.ndarray, more: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text's first word [n + 1], start byte, end byte), texts of a piece together.

    A long text is hashed in parts cut at white space, so memory stays near a multiple of PIECE whatever its length,
    unless a single word is longer. more: tells of lower-cased bytes which of them start a word within a run.
    """
    hashes, starts, ends = [], [], []
    base, total = 0, len(data)
    while base < total:
        stop = min(total, base + PIECE)
        if stop < total:
            tail = data[base:stop]
            gap = np.flatnonzero(_SPACE[tail[-4096:]])
            edge = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[edge] > base:
                stop = int(offsets[edge])
            elif len(gap):
                stop = stop - min(4096, len(tail)) + int(gap[-1]) + 1
            else:
                after = np.flatnonzero(_SPACE[data[stop:]])
                following = int(offsets[edge + 1]) if edge + 1 < len(offsets) else total
                stop = min(following, stop + int(after[0]) + 1 if len(after) else total)
        part = _LOWER[data[base:stop]]
        inside = ~_SPACE[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(offsets, [base, stop])
        cuts = offsets[lo:hi] - base
        cuts = cuts[(cuts >= 0) & (cuts < len(part))]
        begin[cuts] |= inside[cuts]
        if more is not None:
            begin |= more(part) & inside
        s = np.flatnonzero(begin)
        if len(s):
            letters = part[inside]
            at = np.cumsum(inside) - 1
            first = at[s]
            size = np.diff(np.append(first, len(letters)))
            power = _power(int(size.max()))
            place = np.arange(len(letters)) - np.repeat(first, size)
            h = np.add.reduceat(_BYTE[letters] * power[place], first)
            hashes.append(splitmix(h))
            starts.append(s + base)
            ends.append(s + base + size)
        base = stop
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets), start, np.concatenate(ends)


def shingle_at(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the size words from each word on, over words of all texts in a row; the caller drops those that cross texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    multiplier = _POSITION if size <= SHINGLE else stream(12, size) | U(1)
    out = h[:n] * multiplier[0]
    for j in range(1, size):
        out += h[j : n + j] * multiplier[j]
    return splitmix(out)


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of 1 to 4 words."""
    return splitmix((h * _POSITION[: len(h)]).sum(keepdims=True) + U(len(h) * 0xA0761D6478BD642F % 2**64))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 5-word shingles of each text, in order; a shorter text is one shingle, one without words has none."""
    offsets, data = text_buffers(column)
    for first, last in pieces(offsets):
        own = offsets[first : last + 1] - offsets[first]
        h, at, _, _ = words(own, data[offsets[first] : offsets[last]])
        grams = shingle_at(h)
        for k in range(last - first):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield short_shingle(h[a:b])
            else:
                yield np.zeros(0, np.uint64)
