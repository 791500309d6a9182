"""Pages, vectors, the pipeline and empty tables."""

import collections
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from culprit.llm import html_tree, language_kernel, pivot_topk, queries
from tests.llm.test_documents import brute_fingerprint


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1><p>Welcome, to, all, of, you.</p></header>
<nav><a href=/>home</a></nav><div id="sidebar"><p>Popular, posts, and, more, of, them.</p></div><div class="cookie-notice">We use cookies, ok?</div>
<div class="content with-sidebar"><h2>Title &amp; more&#33;</h2><p>First   paragraph, with <a href="#">a link</a>,\n and text that goes on, you see.</p><p>Second one.<p>Third,<br>unclosed
<ul><li>one<li>two, three</ul><form><input><label>name</label></form><div class="ad-box">Buy, now!</div><script>if (a < b) { x = "<p>"; }</script>
<!-- <p>gone</p> --><blockquote>Quote, here</blockquote></div><div class="comments"><p>Nice, article, indeed, a very long comment that goes on, and on, and on.</p></div>
<footer>bye, all</footer></body></html>"""


def test_page():
    want = ["Title & more!", "First paragraph, with a link, and text that goes on, you see.", "Second one.", "Third,", "unclosed", "one", "two, three", "Quote, here"]
    assert html_tree.main_text(PAGE) == "\n\n".join(want)


def test_odd_pages():
    assert html_tree.main_text(None) == html_tree.main_text("") == html_tree.main_text("<nav>a</nav>") == html_tree.main_text("<!-- x") == ""
    assert html_tree.main_text("just text") == "just text"
    assert html_tree.main_text("<div>" * 3000 + "deep &lt;b&gt;") == "deep <b>"
    assert html_tree.main_text("<p>a</b></p></div><p>b") == "a\n\nb"


def test_page_query(spark, edge):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op5_html_tree"](spark, edge[0]).collect()}
    assert got == {0: ("", 0), 1: ("", 0), 2: ("plain", 5), 3: ("a, b & c\n\nd", 11)}


def test_articles_of_the_given_pages(spark):
    import html
    import re

    block = re.compile(r"</?(?:p|h1|h2|br|ul|li|div|table|tr|td)\b[^>]*>")
    given = {r["page_id"]: r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()}
    for r in queries.QUERIES["op5_html_tree"](spark, "/root/testdata/sf0.001").collect():
        article = given[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in block.split(article)]
        assert r.text == "\n\n".join(x for x in parts if x)


def brute_top(table, k=20):
    vectors = {}
    for r in table:
        v = r["embedding"]
        if r["vec_id"] is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(64 * x) for x in v]
        vectors[r["vec_id"]] = min(v, vectors.get(r["vec_id"], v))
    width = max(map(len, vectors.values()))
    ids = sorted(vectors)
    m = np.array([vectors[i] + [0] * (width - len(vectors[i])) for i in ids])
    out = set()
    for i, q in enumerate(ids):
        if q % 20 == 0:
            best = sorted((-int(s), c) for s, c in zip(m @ m[i], ids, strict=True) if c != q)[:k]
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    return out


def test_top_k(spark, edge):
    want = brute_top(pq.read_table(f"{edge[0]}/embeddings.parquet").to_pylist())
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.QUERIES["op7_pivot_topk"](spark, edge[0]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_top_k_with_small_blocks_stops_early_and_stays_exact(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 5)) * 10
    table = [{"vec_id": i, "embedding": (centres[i % 6] + rng.normal(size=5) * 0.1).tolist()} for i in range(600)]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in table], "vec_id bigint, embedding array<double>")
    v = pivot_topk.whole_numbers(df)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_topk.top_k(v, v.filter("vec_id % 20 = 0"), block=32, query_block=8).collect()}
    assert got == brute_top(table)


def test_presence_does_not_depend_on_chunks():
    text = "Ein Wörterbuch, das über 1000 Seiten hat. " * 30
    before = language_kernel.AT_ONCE
    whole = language_kernel.presence(text)
    try:
        language_kernel.AT_ONCE = 37
        assert (language_kernel.presence(text) == whole).all()
    finally:
        language_kernel.AT_ONCE = before
    assert language_kernel.presence("12 ..") is None and language_kernel.presence(None) is None


def test_held_out_languages(spark):
    got = queries.QUERIES["op4_language_kernel"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality_crf"](spark, "/root/testdata/sf0.01").filter("held_out").collect()}
    known = [(r["quality"], got[r["doc_id"]]) for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist() if r["doc_id"] in got]
    assert sum(r.predicted == q for q, r in known) >= 0.95 * len(known)


def test_near_copies_of_four_fifths(spark):
    rng = random.Random(11)
    docs = []
    for n in (1, 4, 7, 30, 90, 90, 400, 1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):  # of words changed
            docs.append((len(docs), " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base)))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(len(docs) + i, passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(5, 90)))) for i in range(40)]
    hot = [f"z{i}" for i in range(200)]
    docs += [(len(docs) + i, " ".join(hot[: 150 + i % 50] + [f"q{i}"] * (i % 3))) for i in range(60)]
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "again " * 40), (len(docs) + 3, "Again " * 90)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, prints = [shingles(t) for _, t in docs], [brute_fingerprint(t, 5) for _, t in docs]
    group, beyond = list(range(len(docs))), 0
    for i in range(len(docs)):
        for j in range(i):
            close, alike = (prints[i] ^ prints[j]).bit_count() <= 4, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
            beyond += alike and not close
            if close or alike:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()}
    assert kept == set(group) and beyond > 20


def test_pipeline(spark, edge):
    docs = spark.read.parquet(f"{edge[0]}/documents.parquet")
    columns = docs.columns
    key = lambda r: (r["doc_id"], r["text"])
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, edge[0]).cache()
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            assert {key(r) for r in after} <= {key(r) for r in before}
            assert not any("!!***" in (r["text"] or "") for r in after)
            assert sum(r["doc_id"] is not None and r["doc_id"] < 60 for r in after) == sum(r["doc_id"] is not None and 0 <= r["doc_id"] < 60 or r["doc_id"] == -5 for r in before if "!!***" not in (r["text"] or ""))
        elif name == "line_dedup":
            assert len(after) == len(before)
        elif name == "near_copies":
            left = [brute_fingerprint(r["text"], 5) for r in after]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(left) for b in left[:i])
            gone = collections.Counter(map(key, before)) - collections.Counter(map(key, after))
            were = collections.Counter(brute_fingerprint(r["text"], 5) for r in before)
            assert gone and all(sum(n for b, n in were.items() if (brute_fingerprint(t, 5) ^ b).bit_count() <= 4) > 1 for _, t in gone)
        elif name == "mix":
            assert {key(r) for r in after} <= {key(r) for r in before} and max(collections.Counter(map(key, after)).values()) <= 2
            words = lambda r: len((r["text"] or "").split())
            largest = collections.defaultdict(int)
            for r in before:
                largest[r["source"]] = max(largest[r["source"]], words(r))
            # whole copies of a few documents: half of each source's largest one may be missing
            assert abs(sum(map(words, after)) - 1.5 * sum(map(words, before))) <= sum(largest.values()) / 2 + 0.02 * sum(map(words, before))
        else:
            assert len(after) == len(before) and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        kept[name] = len(after)
    assert kept["quality"] > kept["near_copies"]
    assert corpus_pipeline.run(spark, edge[0]).count() == kept["bpe"]
