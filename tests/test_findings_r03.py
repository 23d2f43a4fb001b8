"""Cases of the findings of round three."""

from datetime import datetime

import __spark_entry__ as entry


def test_status_pivot_without_prices(spark, tmp_path):
    """Without any price the count of large ones is unknown, as in SQL; with one it is a number."""
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    day = datetime(2020, 1, 1)
    orders = [(1, 1, "F", 200_000.0, day, "x"), (2, 1, "O", None, day, "x"), (3, 2, "F", 1.0, day, "x")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = {r.c_custkey: r for r in entry.queries()["status_pivot"](spark, str(tmp_path)).collect()}
    assert {k: (r.n_f, r.n_large) for k, r in rows.items()} == {1: (1, 1), 2: (1, 0), 3: (0, None)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path, texts, source="s"):
    rows = [(i, x, "en", source, len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_qa_chunks_stream(spark, tmp_path):
    """Reports are read as a stream, not as a data frame each, and a line's type is worked out once; rows are those of report_chunks."""
    from tidemark.operators import passages as P

    documents(spark, tmp_path, ["\n".join(f"Sentence {i} of text {d} says one thing, and another one." for i in range(90)) for d in range(30)])
    df = entry.queries()["qa_chunks"](spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in plan(df) and plan(df).count("TABLE_LIKE") <= 1
    word = lambda w: 1 + len(w) // 6
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        found.setdefault(r.doc_id, []).append((r.chunk, list(r.members), r.tokens))
    for d in range(30):
        rows = [{"id": i + 1, "text": f"Sentence {i} of text {d} says one thing, and another one.", "heading": None, "page_start": 1, "page_end": 1} for i in range(90)]
        assert found[d] == [(c["chunk"], c["members"], c["tokens"]) for c in P.report_chunks(rows, word, lambda text: 2 + sum(map(word, text.split())))]


def test_segmentation_streams(spark):
    """Groups of a key run through several batches and are whole, in order, whatever the partitioning."""
    from tidemark.operators import passages as P

    rows = [(d, i, "PARAGRAPH", f"d{d} w{i} " + "x " * 98) for i in range(40) for d in range(60)]
    b = spark.createDataFrame(rows, "doc_id long, i long, block_type string, text string")
    df = P.segmented(b, "doc_id", "i")
    assert "FlatMapGroupsInPandas" not in plan(df)
    out = sorted((r.doc_id, r.passage_index, r.text.split()[1], r.words, r.blocks) for r in df.collect())
    assert out == sorted((d, p, f"w{3 * p}", 300 if p < 13 else 100, 3 if p < 13 else 1) for d in range(60) for p in range(14))


def test_edit_distance_of_long_sides():
    """Bits of a row at once: two sides of 20,000 tokens take a second or so, and the distance is that of the definition."""
    import random
    import time

    from tidemark.operators import similarity as S

    rng = random.Random(5)
    a = [rng.randint(0, 2_000) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.01]
    b[500:500] = [3_000 + i for i in range(100)]
    began = time.process_time()
    distance = S.edit_distance(a, b)
    assert time.process_time() - began < 3 and len(a) - len(b) + 100 <= distance <= len(a) - len(b) + 200  # deletions, of which up to 100 may be replacements
    for _ in range(200):
        x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            new = [i]
            for j, u in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (s != u)))
            row = new
        assert S.edit_distance(x, y) == row[-1]


def test_matching_blocks_are_those_of_difflib():
    """Also for many equal tokens, as ratio and as word diff."""
    import random
    from difflib import SequenceMatcher

    from tidemark.operators import passages as P
    from tidemark.operators import similarity as S

    rng = random.Random(6)
    for n in range(400):
        x, y = ([f"w{rng.randint(0, n % 9)}" for _ in range(rng.randint(0, 40))] for _ in range(2))
        m = SequenceMatcher(None, x, y, autojunk=False)
        assert S.sequence_ratio(x, y) == (m.ratio() if x or y else None)
        wanted = []
        for op, i, j, k, p in m.get_opcodes():
            wanted += [("equal", x[i:j])] if op == "equal" else [(o, w) for o, w in (("delete", x[i:j]), ("insert", y[k:p])) if w]
        assert P.word_diff(" ".join(x), " ".join(y)) == [(o, " ".join(w)) for o, w in wanted]


def test_nearest_within_in_blocks(spark, monkeypatch):
    """Small blocks, copies, zero and null vectors: the rows of the plain definition, and no join of all with all."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.functions import numbers as N
    from tidemark.operators import retrieval as R

    monkeypatch.setattr(R, "ITEMS", 20)
    monkeypatch.setattr(R, "ASKED", 4)
    rng = random.Random(8)
    few = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(30)]
    rows = [(i, i % 3, rng.choice(few) if i % 11 else [0.0] * 4 if i % 2 else None) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, g int, e array<float>")
    asked = v.where("id % 7 = 0").withColumnRenamed("id", "q")
    found = R.nearest_within(asked, v, "g", 25)
    assert "BroadcastNestedLoopJoin" not in plan(found) and "FlatMapCoGroupsInPandas" in plan(found)
    pairs = asked.withColumnRenamed("e", "a").join(v, "g").where("q <> id").select("q", "id", F.round(N.cosine(F.col("a"), F.col("e")), 9).alias("similarity"))
    wanted = pairs.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))).where("n <= 25").drop("n")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(found) == order(wanted)


def test_discovery_pools_are_not_gathered(spark):
    """Pools are counted apart, so the ranks are cut before the shuffle; rows are those of the definition, nulls too."""
    from tidemark.operators import windows as W

    rows = [(i, "AB"[i % 2] if i % 9 else None, i % 3 if i % 5 else None, float(i * 37 % 50)) for i in range(400)]
    items = spark.createDataFrame(rows, "item long, signal string, company int, m double")
    df = W.discovery_ranks(items, {"global": [], "company": ["company"]}, "signal", "m", "item", 3)
    assert plan(df).count("WindowGroupLimit") >= 4
    found = sorted(((r.rank_scope, r.signal, r.company, r.item, r["rank"], r.pool, round(r.percentile, 6)) for r in df.collect()), key=repr)
    wanted = []
    for scope in ("global", "company"):
        pools = {}
        for r in rows:
            pools.setdefault((r[1], r[2] if scope == "company" else 0), []).append(r)
        for pool in pools.values():
            for k, (i, s, c, _) in enumerate(sorted(pool, key=lambda r: (-r[3], str(r[0])))[:3], 1):
                wanted.append(("global" if scope == "global" else "company" if c is None else f"company|{c}", s, c, i, k, len(pool), round(100 * (len(pool) - k + 1) / len(pool), 6)))
    assert found == sorted(wanted, key=repr)


def test_pair_scores_shuffle_texts_for_pairing_only(spark, tmp_path):
    """Terms are counted in a pair's row: no shuffle beside those that pair the documents, the same figures as before."""
    documents(spark, tmp_path, ["a b b c", "a b b c", "a b d", "", "e"])
    from tidemark.plans.pair_queries import pairs_of, scored_pairs

    scored = scored_pairs(spark, str(tmp_path))
    assert plan(scored).count("Exchange hashpartitioning") == plan(pairs_of(spark, str(tmp_path))).count("Exchange hashpartitioning")
    found = {r.earlier_doc_id: r.lexical_cosine for r in scored.collect()}
    b = 1 + 0.6931471805599453
    assert found[0] == 1.0 and abs(found[1] - (1 + b) / ((2 + b * b) * 3) ** 0.5) < 1e-12 and found[2] is None and found[3] is None


def test_phrases_are_read_once(spark):
    """The words of a text are taken once a row, not once a use; null and short texts are as before."""
    from pyspark.sql import functions as F

    from tidemark.functions import text as T

    df = spark.createDataFrame([("a b c d x a b c d",), ("a b c d",), ("a",), ("",), (None,)], "s string").select(T.repeats_phrase(F.col("s")).alias("v"), T.fragment_share(F.col("s")).alias("f"))
    assert plan(df).count("regexp_extract_all") == 1 and plan(df).count("split(") == 1
    assert [(r.v, r.f) for r in df.collect()] == [(True, 0.0), (False, 0.0), (False, 1.0), (False, 1.0), (None, None)]


def test_compatible_form_sends_odd_texts_only(spark):
    """Every stable character is its own form and begins one; Python gets the odd texts alone."""
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from tidemark.functions import text as T

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    joined = {d.split()[1] for d in map(unicodedata.decomposition, every) if len(d.split()) == 2 and not d.startswith("<")}
    stable = [c for c in every if re.match(f"[{T.STABLE}]", c)]
    assert len(stable) > 20_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and f"{ord(c):04X}" not in joined for c in stable)
    df = spark.createDataFrame([("niño straße",), ("ﬁne ²",), ("é",), ("plain\n",), ("",), (None,)], "s string")
    found = df.select(T.compatible_form(F.col("s")).alias("v"))
    assert plan(found).count("RLIKE") >= 2  # also before the step in Python
    assert [r.v for r in found.collect()] == ["niño straße", "fine 2", "é", "plain\n", "", None]


def test_comparison_texts_are_not_shuffled_twice(spark, tmp_path):
    """The later side's documents are sent to every task, also where no side is small enough for Spark to do so by itself."""
    documents(spark, tmp_path, [f"t{i}" for i in range(600)])
    spark.createDataFrame([(7, 550, "F"), (1_003, 2, "O"), (8, 1, "P"), (9, 999, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()["comparison_chunks"](spark, str(tmp_path))
        assert plan(df).count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, df.collect())) == [(7, "Earlier: t550\n\nLater: t7"), (1_003, "Earlier: t2\n\nLater: t3")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
