"""Long runs without blanks in language identification."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_documents import SCHEMA
from tidemark.llm import language


def test_a_long_run_counts_as_a_whole(spark, monkeypatch):
    rows = [(i, "aba abba baab " * 5, "xx", "s", 0) for i in range(8)] + [(8 + i, "cococ ococo occo " * 5, "yy", "s", 0) for i in range(8)]
    model = language.learned(spark.createDataFrame(rows, SCHEMA))
    run = "abba" * 16 + "coco" * 100
    assert model.languages[int(model.unseen([run])[0].argmax())] == "yy"
    words = [run, "abab", "c" * 50, "o"]
    whole = model.unseen(words)
    monkeypatch.setattr(language, "AT_ONCE", 60)
    assert np.array_equal(model.unseen(words), whole)


def test_unicode_spaces_and_punctuation_end_words():
    text = "a\u00a0b\u3000c\u3002d\u2014\u00e9\u00ab\u4e2d\uff0cz"
    raw = language._spaced(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    assert raw.split() == ["a", "b", "c", "d", "\u00e9", "\u4e2d", "z"]


def plain_model(rows):
    """Counts of words and of n-grams between boundary marks, by language, in plain Python."""
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang in rows:
        words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    for lang, c in words.items():
        for w, n in c.items():
            for k in language.ORDERS:
                for i in range(len(w) + 3 - k):
                    grams[k][lang][f"<{w}>"[i : i + k]] += n
    return words, grams


def plain_prediction(text, words, grams):
    langs = sorted(words)
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not found:
        return "und", 0.0
    log = lambda counts, key: [math.log((counts[x][key] + 0.05) / (sum(counts[x].values()) + 1)) for x in langs]
    total = [0.0] * len(langs)
    for w in found:
        score = [0.0] * len(langs)
        if any(w in words[x] for x in langs):
            score = log(words, w)
        else:
            for k in language.ORDERS:
                parts = [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
                parts = [log(grams[k], p) for p in parts if any(p in grams[k][x] for x in langs)]
                if parts:
                    score = [sum(c) / len(parts) for c in zip(*parts, strict=True)]
                    break
        total = [a + b for a, b in zip(total, score, strict=True)]
    best = max(range(len(langs)), key=lambda i: total[i])
    n = len(found)
    soft = [math.exp((t - total[best]) / n * min(n, language.SURE)) for t in total]
    return langs[best], soft[best] / sum(soft)


def test_predictions_match_plain_python(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi", "te", "su"], "bb": ["ka", "lo", "ri", "do", "\u00e9n"], "cc": ["mi", "do", "pa", "\u00e9n", "zu"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join(word(lang) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", " 12", "\u3000Zu!"]), lang))
    rows += [(240 + i, x, None) for i, x in enumerate([None, "", "12 ..", "unseen", "q", "KALO kalo", "xyx " * 50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {r.doc_id for r in docs.where(language.held_out(F.col("doc_id"))).select("doc_id").collect()}
    words, grams = plain_model([(t, lang) for i, t, lang in rows if lang and i not in fold])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs).collect()}
    for i, text, _ in rows:
        lang, score = plain_prediction(text, words, grams)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, (i, text, got[i], lang, score)
    assert 0 < len(fold) < 240
