"""Corpus operators over pages and vectors against brute force, and the pipeline as a whole."""

import io
import random
from base64 import b32encode
from hashlib import sha1

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, neighbours, warc

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://e", "<p>é</p>"), (None, "http://f", "alone")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    want = []
    for page, _, body in rows:
        data = (body or "").encode()
        same = [p for p, _, b in rows if (b or "") == (body or "") and p is not None]
        refers = max(same) if same and max(same) != page else None
        want.append((page, len(data), b32encode(sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert out == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame(rows, PAGES), least=8).where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_records_have_names_of_their_own(spark, tmp_path):
    import gzip

    rows = [(5, "http://a", "same"), (5, "http://a", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (3, "http://b", "other"), (None, "http://c", "same"), (None, "http://c", "x"), (None, "http://c", "x")]
    warc.archived(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    records = [r for f in tmp_path.glob("w/*.gz") for r in warc.read_warc(io.BytesIO(gzip.decompress(f.read_bytes()))) if r.headers["WARC-Type"] != "warcinfo"]
    ids = {r.headers["WARC-Record-ID"]: r for r in records}
    assert len(records) == len(rows) == len(ids)
    revisits = [r for r in records if r.headers["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for r in revisits:
        of = ids[r.headers["WARC-Refers-To"]]
        assert of.headers["WARC-Type"] == "response" and of.headers["X-Page-Id"] == "5" and of.headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.write_arc([("http://a/ b", "20210203040506", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n"), (None, "2021", "text/plain", b"")], version)
    records = list(warc.read_arc(data))
    assert [r.content for r in records] == [b"HTTP/1.1 200 OK\r\n\r\nbody\n", b""] and records[0].version == version
    assert records[0].fields["URL"] == "http://a/%20b" and records[0].fields["Content-type"] == "text/html"
    assert warc.timestamp(records[0].fields["Archive-date"]) == "2021-02-03T04:05:06Z" and warc.timestamp("2021") == "2021-01-01T00:00:00Z"
    made = warc.converted(records[0], 7, None)
    (again,) = warc.read_warc(io.BytesIO(warc.serialised(made) + b"\r\n\r\n"))
    assert again == made and made.headers["WARC-Payload-Digest"] == f"sha1:{warc.digest(b'body' + bytes([10]))}"
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-12]))


PAGE = """<html><head><title>x</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>First  part<br>of<p>Second <i>one</i>.</p><div id="comments"><p>Great post</p></div>
<ul><li>a<li>b</ul><form>f</form></article><aside>Side</aside><footer>&copy; F</footer></body></html>"""


def test_html_extraction():
    assert html.extracted(PAGE) == "Head & line\nFirst part of\nSecond one.\na\nb"
    assert html.extracted(None) == html.extracted("") == ""
    assert html.extracted("plain &lt;text&gt; <!-- never closed") == "plain <text>"
    assert html.extracted("<body><p>only <script>x") == "only"


def test_template_without_article(spark):
    def page(i):
        return f'<html><body><div class="top"><a href="/">Start</a> <a href="/n">News</a></div><div class="wrap"><div class="c1"><p>Unique story number {i} with many words of its own {"word " * (i % 7 + 30)}</p></div></div><div class="low">Our company address</div></body></html>'

    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)] + [(100, None, None), (101, "http://h/1", page(1))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3].startswith("Unique story number 3") and "address" not in got[3] and "News" not in got[3]
    assert got[100] == "" and got[101] == got[1]
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_second_layout_and_long_notice(spark):
    notice = "This notice stands on each page of the host. " * 8
    items = "".join(f"<p>Term {k} of the host</p>" for k in range(450))

    def plain(i):
        return f"<html><body><h1>Title {i}</h1><div class='a'><p>Story {i} goes on {'and on ' * 40}</p></div><ul><li>Point {i}</li></ul><div class='b'><p>{notice}</p>{items}</div></body></html>"

    rows = [(i, f"http://two/{i}", f"<html><body><article><p>Article {i} {'word ' * 80}</p></article></body></html>") for i in range(9)]
    rows += [(9, "http://two/9", "<html><body><div><p>The other layout</p></div></body></html>")]
    rows += [(20 + i, f"http://one/{i}", plain(i)) for i in range(5)] + [(30 + i, f"http://copies/{i}", plain(7)) for i in range(3)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[9] == "The other layout"
    assert got[21].split("\n") == ["Title 1", ("Story 1 goes on " + "and on " * 40).strip(), "Point 1"]
    assert "Story 7" in got[30] and got[30] == got[32]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:400] = v[100]  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, ratio=1e9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = v.astype(np.float64)
    for q in range(0, 600, 20):
        s = (w * w[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        assert [x[1] for x in sorted(got[q])] == order
        assert np.allclose([x[2] for x in sorted(got[q])], s[order], atol=1e-12)
    assert set(got) == set(range(0, 600, 20))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, F.col("vec_id") == 0, k=5).count() == 2
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        s = v @ v[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (200 * 20) >= 0.9


WRAP = '<html><body><div class="top"><a href="/">Start</a></div><article><h1>Title {i}</h1>{body}</article><div class="low">Our address</div></body></html>'


def test_slots_keep_what_names_only_resemble(spark):
    for n in (1, 12):
        bodies = {i: f"<p>Story {i} goes on.</p>" for i in range(n)}
        bodies[0] = '<p class="notice-of-meeting">The notice.</p><section id="search-results-analysis"><p>The analysis.</p></section><div class="cookie-notice">Cookies</div><p>End.</p>'
        rows = [(i, f"http://h/{i}", WRAP.format(i=i, body=b)) for i, b in bodies.items()]
        got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
        assert got[0] == "Title 0\nThe notice.\nThe analysis.\nEnd."
    assert not html.says_so("notice-of-meeting") and html.says_so("adSlot2") and html.says_so("reader-comments")


def test_template_within_articles(spark):
    """A text in every article of a host is template, one in most of them isn't; of few pages none is."""
    def page(i):
        often = "<p>A line that many share.</p>" if i % 3 else ""
        return WRAP.format(i=i, body=f"<p>Posted by the desk.</p><p>Story {i}.</p>{often}")

    rows = [(i, f"http://h/{i}", page(i)) for i in range(html.FULL)] + [(100 + i, f"http://few/{i}", page(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == "Title 0\nStory 0." and got[1] == "Title 1\nStory 1.\nA line that many share."
    assert got[101] == "Title 1\nPosted by the desk.\nStory 1.\nA line that many share."


def test_repeated_rows_are_like_single_ones(spark):
    def page(i):
        return f'<html><body><div class="top"><a href="/">Start</a> <a href="/n">News</a></div><div class="c1"><p>Story {i} goes on {"and on " * i}.</p></div><div class="low">Our address</div></body></html>'

    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)]
    once = sorted(map(tuple, html.main_text(spark.createDataFrame(rows, PAGES)).collect()))
    twice = sorted(map(tuple, html.main_text(spark.createDataFrame(rows * 2, PAGES)).collect()))
    assert twice == sorted(once * 2) and once[3][2] == "Story 3 goes on and on and on and on ."


def test_classes_keep_order_and_nest():
    before = np.array([[0, 1, 1, 1], [0, 0, 1, 1], [0, 1, 0, 1], [0, 0, 0, 0]], bool)  # 1 and 2 stand either way
    assert html.ordered(before).tolist() == [0, 2, 3]
    e = html.Evidence([1, 1, 2, 2, 3, 3], [10, 11, 20, 21, 30, 31])
    e.add(html.Page([10, 20, 21, 20, 21, 11, 30, 31]))
    assert not e.crossing and e.before[1].tolist() == [[False, True], [False, False]]
    e.add(html.Page([10, 20, 11, 21, 31, 30]))
    assert e.crossing == {(1, 2)} and e.before[3].all(where=~np.eye(2, dtype=bool))


def test_order_decides_what_is_template(spark):
    """A text whose place among the template's tokens changes from page to page is no template."""
    def page(i):
        fixed, loose = '<div class="low">Our address</div>', '<div class="x">A wandering line</div>'
        body = f'<div class="c"><p>Story {i}.</p></div>'
        return f'<html><body><div class="top">Welcome here</div>{loose + body + fixed if i % 2 else body + fixed + loose}</body></html>'

    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(10)], PAGES)).collect()}
    assert got[0] == "Story 0.\nA wandering line" and got[1] == "A wandering line\nStory 1."


def brute_nearest(rows, asked, k):
    """{query: [(vec_id, score)]} over rows that repeat ids; a query id in several vectors takes the best score of each row."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if asked(i)}):
        score = np.max([(v * x).sum(axis=1) for x in v[ids == q]], axis=0)
        at = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in at]
    return out


def test_repeated_rows_are_candidates_each(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(60) for _ in range(25)]
    rows += [(i, v[3].tolist()) for i in range(3, 50)] + [(20, v[5].tolist()), (200, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, ratio=1e9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12) for q in want)


@pytest.mark.parametrize("levels", [6, 1])
def test_long_lists_are_split(spark, monkeypatch, levels):
    for name, value in (("LISTS", 3), ("SPLIT", 200), ("PART", 60), ("BLOCK", 150), ("LEVELS", levels)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(list(enumerate(v)), lambda i: i % 20 == 0, 20)
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(want, 20)
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * 20 * len(want)
    assert all(abs(s - float(v[i] @ v[q])) < 1e-9 for q, x in got.items() for i, s in x)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_documents import prose

    rng = random.Random(3)
    item = prose(rng, 40)
    base = [prose(rng, rng.randint(30, 80)) for _ in range(20)]
    texts = [*base, base[0], base[1] + " tail", prose(rng, 20) + " " + item, "12345 ...", None, base[2][:50] + " token=abcdefghijk"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(range(len(texts)))
    assert left == [every - {23, 24}, every - {20, 21, 23, 24}, every - {20, 21, 22, 23, 24}, every - {20, 21, 22, 23, 24}]
    assert "abcdefghijk" not in docs.where("doc_id = 25").first().text
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == left[-1]


def _batches(docs):
    """(rows, bytes) of each batch that Python gets."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    return [tuple(r) for r in docs.mapInArrow(run, "n long, size long").collect()]


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontamination", "packing"])
def test_pipeline_bounds_the_batches_of_python(spark, tmp_path, name):
    import corpus_pipeline

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    stage = dict(corpus_pipeline.STAGES)[name]
    few = spark.createDataFrame([(1, "one text of a few words", "en", "s", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 400).alias("text"))
    known = spark.conf.getAll.get(bound)
    try:
        spark.conf.unset(bound)
        stage(spark, few, str(tmp_path))
        got = _batches(wide)
        assert sum(n for n, _ in got) == 4000 and max(size for _, size in got) <= 4 << 20
        spark.conf.set(bound, "300000")  # the session's own bound stays
        stage(spark, few, str(tmp_path))
        assert max(size for _, size in _batches(wide)) < 400_000
    finally:
        spark.conf.unset(bound) if known is None else spark.conf.set(bound, known)
