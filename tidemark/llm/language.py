"""Language identification by known words, backing off to character n-grams for the rest.

The model knows every word of its sample with its log frequency in each language. A word that it doesn't know is
scored by its longest known character n-grams: all of the order in which any is known, from five characters down to
one. A text gets the language with the largest sum over its words; its score is that language's share after a softmax
of the mean over the words.

Words are runs of ASCII letters and characters outside ASCII other than Unicode white space and punctuation, lower-cased
in ASCII and Latin-1; the n-grams of a word are those of the whole word. A text that is null or has no
letter is `und` with score 0, as is every text if nothing could be learned. Ties go to the first language by name.
Learning takes labelled rows with non-null text, a bounded sample of them: those with the smallest hashes, about
TRAIN_DOCS at most (a classifier's sample; prediction covers every row and the whole text). Rows with a null doc_id are
never learned from. Repeated rows are predicted each.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import aside, lean
from .kernels import U, pieces, splitmix, stream, text_buffers, words

#: Labelled documents that are learned from, about, at most; scores that a worker remembers.
TRAIN_DOCS, REMEMBERED = 12_000, 200_000
ORDERS = (5, 4, 3, 2, 1)
#: Words up to which more of them make the score surer.
SURE = 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


#: Characters outside ASCII, up to U+FFFF, that end a word.
_ENDS = np.array([0x80 <= c and (chr(c).isspace() or unicodedata.category(chr(c))[0] in "PZ") for c in range(1 << 16)])


def _spaced(data: np.ndarray) -> np.ndarray:
    """Everything but letters becomes a blank, a character of several bytes as many; Latin-1 capitals (0xC3 0x80-0x9E but 0x97) become small."""
    out = np.where(_LETTER[data], data, np.uint8(0x20))
    after = np.flatnonzero(out[:-1] == 0xC3) + 1 if len(out) > 1 else np.zeros(0, np.int64)
    after = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[after] += 0x20
    for lead, end, size in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3)):
        at = np.flatnonzero((data >= lead) & (data < end))
        at = at[at + size <= len(data)]
        code = data[at].astype(np.int64) & (0xFF >> (size + 1))
        for j in range(1, size):
            code = code << 6 | (data[at + j] & 0x3F)
        at = at[_ENDS[code]]
        for j in range(size):
            out[at + j] = 0x20
    return out


_MOVES = {n: stream(60 + n, n) | U(1) for n in ORDERS}
#: Characters of words whose n-grams are scored at a time; a longer word makes a batch of its own.
AT_ONCE = 1 << 17


def gram_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all words between boundary marks, word of each character; -1 between words)."""
    text = "\n".join(f"<{w}>" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    gap = chars == 10
    return chars, np.where(gap, -1, np.cumsum(gap))


def gram_hashes(chars: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every n-gram that lies within a word."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = (word[:m] >= 0) & (word[:m] == word[n - 1 :])
    h = chars[:m] * _MOVES[n][0]
    for j in range(1, n):
        h += chars[j : m + j] * _MOVES[n][j]
    return splitmix(h[inside] + U(n)), word[:m][inside]


@dataclass
class Model:
    """Sorted word hashes and n-gram hashes with their log frequencies by language."""

    languages: list[str]
    hashes: np.ndarray
    rows: np.ndarray
    grams: np.ndarray
    gram_rows: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by their longest known n-grams; 0 for a word without any known character."""
        ends = np.cumsum([len(w) for w in words])
        if len(words) > 1 and ends[-1] > AT_ONCE:
            parts, first = [], 0
            while first < len(words):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, "right")))
                parts.append(self.unseen(words[first:last]))
                first = last
            return np.concatenate(parts)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        chars, word = gram_runs(words)
        open_ = np.ones(len(words) + 1, bool)  # the last stands for gaps
        open_[-1] = False
        for n in ORDERS if len(self.grams) else ():
            h, owner = gram_hashes(chars, word, n)
            mine = open_[owner]
            h, owner = h[mine], owner[mine]
            at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            known = self.grams[at] == h
            if known.any():
                at, owner = at[known], owner[known]
                total = np.zeros_like(out)
                np.add.at(total, owner, self.gram_rows[at])
                count = np.bincount(owner, minlength=len(words))
                hit = count > 0
                out[hit] = total[hit] / count[hit, None]
                open_[:-1][hit] = False
        return out


def counted(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts, added up within each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _spaced(np.frombuffer(text.encode(), np.uint8)) if text else np.zeros(0, np.uint8)
                counts[lang].update(raw.tobytes().lower().split())
            rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in counts.items() for w, n in c.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learned(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled (doc_id, lang, text). What comes to the driver is bounded by the words of train_docs documents."""
    labelled = labelled.where("doc_id is not null and lang is not null and text is not null")
    total = labelled.count()
    share = min(1.0, train_docs / max(total, 1))
    sample = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)) if share < 1 else labelled
    found = counted(sample).toArrow().combine_chunks()
    return fitted(found.column("lang"), found.column("word"), found.column("n"))


def fitted(lang: pa.ChunkedArray, word: pa.ChunkedArray, n: pa.ChunkedArray) -> Model:
    """The model of counted words; arrays of their characters instead of an object a word."""
    languages = sorted(pc.unique(lang).to_pylist())
    k = len(languages)
    coded = word.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    place = pc.index_in(lang, pa.array(languages, pa.string())).to_numpy(zero_copy_only=False) if k else np.zeros(0, np.int64)
    counts = np.zeros((len(coded.dictionary), k), np.float32)
    np.add.at(counts, (coded.indices.to_numpy(zero_copy_only=False), place), n.to_numpy())
    vocabulary = coded.dictionary.to_pylist()
    del coded, lang, word, n
    table = np.log((counts + 0.05) / (counts.sum(axis=0, dtype=np.float64) + 1.0)).astype(np.float32)
    joined = np.frombuffer(b" ".join(w.encode() for w in vocabulary), np.uint8)
    h, *_ = words(np.array([0, len(joined)]), joined)
    by_hash = np.argsort(h)
    grams, gram_rows = [], []
    for order in ORDERS if vocabulary else ():
        known, total = np.zeros(0, np.uint64), np.zeros((0, k))
        for at in range(0, len(vocabulary), 1 << 16):  # bounds the arrays of characters
            g, owner = gram_hashes(*gram_runs(vocabulary[at : at + (1 << 16)]), order)
            here, back = np.unique(g, return_inverse=True)
            some = np.stack([np.bincount(back, counts[at + owner, i], len(here)) for i in range(k)], axis=1)
            both, back = np.unique(np.concatenate([known, here]), return_inverse=True)
            added = np.zeros((len(both), k))
            added[back[: len(known)]] = total
            added[back[len(known) :]] += some
            known, total = both, added
        grams.append(known)
        gram_rows.append(np.log((total + 0.05) / (total.sum(axis=0) + 1.0)).astype(np.float32))
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order_ = np.argsort(every)
    return Model(languages, h[by_hash], table[by_hash], every[order_], np.concatenate(gram_rows)[order_] if gram_rows else np.zeros((0, k), np.float32))


def predicted(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The columns of docs (text only if kept) with lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    out = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[int, int] = {}
        scores = np.zeros((1024, max(1, len(m.languages))), np.float32)
        k = scores.shape[1]
        for batch in batches:
            langs, sure = [], []
            offsets, data = text_buffers(batch.column(place))
            for first, last in pieces(offsets):
                own = offsets[first : last + 1] - offsets[first]
                plain = data[offsets[first] : offsets[last]]
                spaced = _spaced(plain)
                h, at, start, end = words(own, spaced)
                rows = np.zeros((len(h), k), np.float32)
                if len(h) and len(m.hashes):
                    slot = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
                    seen = m.hashes[slot] == h
                    rows[seen] = m.rows[slot[seen]]
                    new, where, back = np.unique(h[~seen], return_index=True, return_inverse=True)
                    if len(known) > REMEMBERED:
                        known = {}
                    ids = np.array([known.get(x, -1) for x in new.tolist()], np.int64)
                    fresh = np.flatnonzero(ids < 0)
                    if len(fresh):
                        at_word = np.flatnonzero(~seen)[where[fresh]]
                        raw = spaced.tobytes()
                        found = m.unseen([raw[a:b].lower().decode("utf-8", "replace") for a, b in zip(start[at_word].tolist(), end[at_word].tolist(), strict=True)])
                        ids[fresh] = np.arange(len(known), len(known) + len(fresh))
                        known.update(zip(new[fresh].tolist(), ids[fresh].tolist(), strict=True))
                        while len(scores) < len(known):
                            scores = np.concatenate([scores, np.zeros_like(scores)])
                        scores[ids[fresh]] = found
                    if len(new):
                        rows[~seen] = scores[ids[back]]
                sums = np.zeros((last - first, k))
                n = np.diff(at)
                some = np.flatnonzero(n > 0)
                if len(some):
                    sums[some] = np.add.reduceat(rows.astype(np.float64), at[some], axis=0)
                low = (plain | 0x20) if len(plain) else plain
                latin = np.append(0, np.cumsum((low >= 0x61) & (low <= 0x7A)))
                has = latin[own[1:]] > latin[own[:-1]]
                for i in np.flatnonzero(~has & (n > 0)).tolist():
                    has[i] = any(c.isalpha() for c in plain[own[i] : own[i + 1]].tobytes().decode("utf-8", "replace"))
                mean = sums / np.maximum(n, 1)[:, None] * np.minimum(np.maximum(n, 1), SURE)[:, None]
                best = sums.argmax(axis=1)
                soft = np.exp(mean - mean.max(axis=1, keepdims=True))
                soft /= soft.sum(axis=1, keepdims=True)
                for i in range(last - first):
                    if has[i] and m.languages:
                        langs.append(m.languages[best[i]]), sure.append(float(soft[i, best[i]]))
                    else:
                        langs.append("und"), sure.append(0.0)
            kept = [c for i, c in enumerate(batch.columns) if keep_text or i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(sure, pa.float64())], [*(f.name for f in out), "lang_pred", "score"])

    return docs.mapInArrow(lean(run), StructType([*out, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learned outside the held-out fold."""
    model = learned(docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id"))))
    return predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, rejected: tuple[str, ...] = ("und",)) -> DataFrame:
    """docs without those whose language can't be told; all columns stay."""
    model = learned(docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id"))))
    docs, back = aside(docs, "text")
    return back(predicted(docs, model, keep_text=True).where(~F.col("lang_pred").isin(*rejected)))
