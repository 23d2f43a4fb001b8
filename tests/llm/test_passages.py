"""Recall of repeated passages on planted cases."""

import random

import pytest

from tests.llm.test_documents import frame, prose
from tidemark.llm import substring


@pytest.mark.parametrize("group", [1024, 4])
def test_all_exact_passages_are_found(spark, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (51, 53, 60, 75, 120)]
    texts, planted = [], {}
    for i in range(80):
        p = shared[i % 5] if i < 50 else None
        texts.append(" ".join(filter(None, [prose(rng, rng.randint(0, 90)), p, prose(rng, rng.randint(0, 90))])))
        if p:
            planted[i] = len(p.split())
    got = {}
    for r in substring.repeated_passages(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r.n_words)
    assert set(got) == set(planted)
    assert all(max(got[i]) >= 45 for i in planted) and (group < 1024 or all(abs(max(got[i]) - n) <= 2 for i, n in planted.items()))


def test_edited_passages_are_mostly_found(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        p = prose(rng, 70).split()
        q = list(p)
        at = rng.randrange(70)
        if rng.random() < 0.5:
            q[at] = "edited"
        else:
            q.insert(at, "added")
        texts += [prose(rng, 40) + " " + " ".join(p), " ".join(q) + " " + prose(rng, 40)]
    found = {r.doc_id for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert len(found) >= 0.9 * len(texts)


def test_group_size_changes_no_result(spark, monkeypatch):
    rng = random.Random(13)
    p = prose(rng, 70).split()
    edited = [*p[:35], "edited", *p[36:]]
    added = [*p[:40], "added", *p[40:]]
    texts = [" ".join([prose(rng, 60), *(edited if i == 7 else added if i == 8 else p), prose(rng, 60)]) for i in range(24)]
    # three hold more of what stands around the passage than the rest
    more = [prose(rng, 20), *p, prose(rng, 20)]
    texts += [" ".join([prose(rng, 60), *more, prose(rng, 60)]) for _ in range(3)]
    docs = frame(spark, texts)
    rows = {}
    for group in (1024, 8):
        monkeypatch.setattr(substring, "GROUP", group)
        rows[group] = sorted(map(tuple, substring.repeated_passages(docs).collect()))
    assert rows[8] == rows[1024]
    assert {r[0] for r in rows[8]} == set(range(27))


@pytest.mark.parametrize("group", [1024, 64])
def test_edited_copies_of_one_passage_are_found(spark, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    rng = random.Random(17)
    p = prose(rng, 56).split()
    texts = []
    for i in range(1500 if group == 1024 else 300):
        q = list(p)
        q[rng.randrange(56)] = f"w{i}"
        texts.append(" ".join([prose(rng, 5), *q, prose(rng, 5)]))
    found = {r.doc_id for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert len(found) >= 0.95 * len(texts)


def test_columns_of_other_tables_and_repeated_ids(spark):
    rng = random.Random(18)
    shared = prose(rng, 60)
    rows = [(1, prose(rng, 20) + " " + shared, 1, 2, 3), (1, prose(rng, 80), 1, 2, 3), (2, shared, 1, 2, 3), (2, shared, 1, 2, 3), (3, prose(rng, 90), 1, 2, 3), (None, shared, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value int, n int, rep_doc_id int")
    got = {(r.doc_id, r.rep_doc_id) for r in substring.repeated_passages(docs).collect()}
    assert got == {(1, 1), (2, 1)}


def test_recall_of_near_passages_against_brute_force(spark):
    """Every pair of texts with 46 tokens of which 41 agree in place or at a shift, by comparing all places."""
    rng = random.Random(19)
    texts = []
    for _ in range(60):
        p = prose(rng, rng.randint(50, 90)).split()
        for _ in range(2):
            q = list(p)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(q))
                q[at : at + rng.randint(0, 1)] = ["w" + str(rng.randrange(10**6))]
            texts.append(" ".join([prose(rng, rng.randint(0, 30)), *q, prose(rng, rng.randint(0, 30))]))
    tokens = [[tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)] for t in texts]
    want = set()
    for k in range(0, len(texts), 2):
        a, b = tokens[k], tokens[k + 1]
        where = {t: i for i, t in enumerate(b)}
        shift = [where[t] - i if t in where else None for i, t in enumerate(a)]
        for d in {s for s in shift if s is not None}:
            for more in (-2, -1, 0, 1, 2):
                hits = [s in (d, d + more) for s in shift]
                if any(sum(hits[i : i + substring.TOKENS]) >= substring.AGREE for i in range(len(hits) - substring.TOKENS + 1)):
                    want |= {k, k + 1}
    found = {r.doc_id for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert len(want) > 60 and found <= set(range(len(texts))) and len(found & want) >= 0.9 * len(want)


def test_pairs_of_blocks_are_written_to_few_files(spark, monkeypatch):
    """op10_substring_dedup: the many tasks of a large group leave one file, and the rows are those of whole groups."""
    rng = random.Random(20)
    p = prose(rng, 60).split()
    texts = []
    for i in range(40):
        q = list(p)
        q[rng.randrange(60)] = f"w{i}"
        texts.append(" ".join([prose(rng, 5), *q, prose(rng, 5)]))
    docs = frame(spark, texts)
    whole = sorted(map(tuple, substring.repeated_passages(docs).collect()))
    files = {}

    def spy(df, tag, *more, write=substring.written):
        out = write(df, tag, *more)
        files[tag] = len(out.inputFiles())
        return out

    monkeypatch.setattr(substring, "GROUP", 4)
    monkeypatch.setattr(substring, "written", spy)
    assert sorted(map(tuple, substring.repeated_passages(docs).collect())) == whole
    assert whole and files["found"] == 1
