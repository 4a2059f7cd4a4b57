"""Nearest neighbours against brute force, HTML extraction on small sites."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import html, nearest, queries


def brute(vectors, k=20, step=20):
    out = {}
    for q, x in vectors.items():
        if q % step == 0:
            scores = sorted((-float(np.dot(x, y)), i) for i, y in vectors.items() if i != q)[:k]
            out[q] = [i for _, i in scores]
    return out


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute({r.vec_id: np.array(r.embedding, float) for r in rows})
    got = {}
    for r in queries.op1_cross_polytope(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_blocks_norms_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    own = {i: rng.normal(size=7) * rng.uniform(0.1, 5) for i in range(160)}
    for i in range(200, 260):
        own[i] = own[20]
    rows = [(i, [float(v) for v in x], "clash") for i, x in own.items()]
    rows += [(5, rows[5][1], "again"), (300, None, ""), (320, [0.0] * 7, ""), (340, [1.0] * 6 + [None], ""), (360, [1.0] * 6 + [math.nan], ""), (380, [math.inf] * 7, ""), (400, [1.0, 2.0], ""), (None, [1.0] * 7, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = nearest.neighbours(frame, F.col("id") % 20 == 0, k=9, tables=12, probes=0.7, index_block=11, query_block=3).collect()
    want = brute(own, 9)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(np.dot(own[r.query_id], own[r.vec_id]))) < 1e-9
    assert got.keys() == want.keys() and all(len(got[q]) == 9 for q in want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 9 for q in want]) >= 0.9
    assert got[200] == want[200]


def test_tiny_vector_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert nearest.neighbours(spark.createDataFrame([], kind), F.col("id") % 20 == 0).count() == 0
    assert nearest.neighbours(spark.createDataFrame([(0, [1.0, 0.0])], kind), F.col("id") % 20 == 0).count() == 0
    three = nearest.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], kind), F.col("id") % 20 == 0)
    assert [tuple(r) for r in three.orderBy("rank").collect()] == [(0, 1, 2, 0.0), (0, 2, 1, -1.0)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(nearest.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(nearest.hadamard(nearest.hadamard(x)), x)


def page(body):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>" + body


def extract(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return {r.page_id: r for r in html.extract(frame).collect()}


def test_pages(spark):
    main = "<article><h1>Head &amp; line</h1><p>One <b>two</b>\n three<br>four<p>five&nbsp;six &lt;x&gt;</article>"
    rows = [
        (1, "https://a.example/x", page(f"<nav><ul><li><a href=/>menu</a></ul></nav><div class='ad'>buy</div>{main}<footer>foot</footer></body></html>"), "clash"),
        (2, "https://a.example/y", page(f"{main}<div id=comments><p>nice</div><aside>side</aside>"), ""),
        (3, None, None, None),
        (4, "nonsense", "", ""),
        (5, "http://b.example", "plain text only", ""),
        (6, "http://b.example", "<div>first<div>second</div>third<form>f<input></form></div><p>x < y <!-- c --> z", ""),
        (7, "http://b.example", "<p>a<script>while(1<2){}", ""),
        (8, "http://b.example", "<main><p>kept</p><p hidden>not</p></main><p>outside</p>", ""),
    ]
    got = extract(spark, rows)
    assert got[1].text == got[2].text == "Head & line One two three four five six <x>" and got[1].n_chars == len(got[1].text)
    assert got[3].text == got[4].text == "" and got[5].text == "plain text only"
    assert got[6].text == "first second third x < y z" and got[7].text == "a" and got[8].text == "kept"
    assert extract(spark, []) == {}


def test_style_tree_drops_what_a_site_repeats(spark):
    rng = random.Random(1)
    body = "<div class=box><p>Follow us everywhere</p></div><div class=story><p>{}</p><p>{}</p></div>"
    own = [" ".join(str(rng.random()) for _ in range(5)) for _ in range(60)]
    rows = [(i, "http://c.example/p", page(body.format(own[2 * i], own[2 * i + 1])), "") for i in range(30)]
    same = [(100 + i, "http://d.example/p", page("<div class=story><p>copied page</p></div>"), "") for i in range(30)]
    got = extract(spark, rows + same)
    assert all(got[i].text == f"{own[2 * i]} {own[2 * i + 1]}" for i in range(30))
    assert all(got[100 + i].text == "copied page" for i in range(30))


def test_copies_of_a_page_are_no_frame(spark):
    """The headlines of distinct pages stay beside a large group of copies; each copy stays whole."""
    body = "<div class=story><h1>{}</h1>{}</div>"
    rng = random.Random(2)
    copy = body.format("copied head", "<p>copied text</p>")
    own = [body.format(f"head {k}", "".join(f"<p>{rng.random()}</p>" for _ in range(20))) for k in range(60)]
    got = extract(spark, [(i, "http://e.example/p", page(x), "") for i, x in enumerate([copy] * 300 + own)])
    assert all(got[i].text == "copied head copied text" for i in range(300))
    assert all(got[300 + k].text.startswith(f"head {k} ") for k in range(60))


def test_frame_goes_where_it_prevails(spark):
    """More frame blocks than own blocks, and a group of copies that differ in a counter, which stay whole."""
    frame = "".join(f"<div class=part{c}>Frame number {c}</div>" for c in "abcd")
    rng = random.Random(3)
    own = [[f"story {rng.random()} {rng.random()}" for _ in range(3)] for _ in range(30)]
    rows = [(i, "http://f.example/p", page(frame + "<div class=story>" + "".join(f"<p>{x}</p>" for x in own[i]) + "</div>"), "") for i in range(30)]
    long = " ".join(["copied"] * 100)
    rows += [(100 + i, "http://g.example/p", page(f"<div class=story><h1>head of it</h1><p>{long}</p></div><div class=count>{i} views</div>"), "") for i in range(30)]
    got = extract(spark, rows)
    assert all(got[i].text == " ".join(own[i]) for i in range(30))
    assert all(got[100 + i].text == f"head of it {long} {i} views" for i in range(30))


def test_repeated_rows_take_one_place(spark):
    """Ids with several rows, equal ones and others, fill one of the k places each."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0])]
    for i in range(1, 60):
        x = [1.0 - i / 100, *rng.normal(size=2).tolist()]
        rows += [(i, x)] * 3 + ([(i, [v - 1e-4 * n for v in x]) for n in range(1, 30)] if i < 5 else [])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.neighbours(frame, F.col("id") == 0, k=20, tables=4, probes=10.0, index_block=10_000).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21))


def test_importance_is_the_entropy_of_the_site(spark):
    """Importances against a brute-force tree; a pool of frame texts on a large host goes although no list names its elements."""
    rng = random.Random(7)
    pool = [f"offer {k}" for k in range(4)]
    rows, texts = [], {}
    for i in range(120):
        own = [f"story {rng.random()}" for _ in range(rng.randrange(1, 4))]
        strip = rng.choice(pool)
        rows.append((i, "http://h.example/p", page(f"<div class=strip>{strip}</div><div class=story>" + "".join(f"<p>{x}</p>" for x in own) + "</div>"), ""))
        texts[i] = (strip, own)
    rows += [(500 + i, *rows[0][1:]) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.node: r for r in html.site_nodes(frame).collect()}

    def entropy(values):
        n = len(values)
        counts = [values.count(x) for x in set(values)]
        return (math.log(n) - sum(c * math.log(c) for c in counts) / n) / math.log(n)

    strips = entropy([s for s, _ in texts.values()])
    assert abs(got[">html>body>div.strip"].importance - strips) < 1e-9 and got[">html>body>div.strip"].seen == 120
    shapes = [len(own) for _, own in texts.values()]
    assert abs(got[">html>body>div.story"].importance - (0.9 * 1 + 0.1 * entropy(shapes))) < 1e-9
    assert {r.host: r.low for r in html.low_nodes(html.site_nodes(frame)).collect()} == {"h.example": [">html>body>div.strip"]}
    found = extract(spark, rows)
    assert all(found[i].text == " ".join(own) for i, (_, own) in texts.items()) and found[530].text == found[0].text


def test_odd_pages(spark):
    """Deep nesting, a very long page, unmatched quotes, repeated rows and listed inline elements."""
    deep = "<div>" * 3000 + "inner" + "</div>" * 3000
    rows = [(1, "http://k.example", deep, ""), (2, "http://k.example", "<p>" + "word " * 200_000, ""), (3, "http://k.example", "<p class=\"x>lost</p><p>kept</p>", ""), (4, "http://k.example", "<p>a <span class=ad>buy</span> b</p>", "")]
    frame = spark.createDataFrame(rows + rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(frame).collect()]
    assert len(got) == 8 and len(set(got)) == 4
    text = {i: t for i, t, _ in got}
    assert text[1] == "inner" and text[2] == " ".join(["word"] * 200_000) and "kept" in text[3] and text[4] == "a b"


def test_buckets_grow_and_lengths_are_spaces(spark):
    assert [nearest.Rotations(64, 1.0, n).widths for n in (100, 5_000, 50_000, 10**7)] == [[256], [256, 2], [256, 16], [256, 256, 16]]
    rng = np.random.default_rng(5)
    own = {i: rng.normal(size=6) for i in range(300)}
    other = {i: rng.normal(size=4) for i in range(1000, 1040)}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in (own | other).items()], "vec_id long, embedding array<double>")
    got = {}
    found = nearest.neighbours(frame, F.col("id") % 20 == 0, k=5, bucket_rows=2, probes=4.0, index_block=40, query_block=4).collect()
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(own, 5) | brute(other, 5)
    assert got.keys() == want.keys() and np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_class_words_inside_an_article(spark):
    """Inside an article, a class is a part of the page only as a whole; what isn't shown goes."""
    inside = "<p class='share-price'>price</p><p class='reply-hint'>hint</p><section class='promo-story'><p>story</p></section>"
    gone = "<div class='ad-banner'>buy</div><div class='comments'><p>nice</p></div><ul class='comment-list'><li>more</li></ul><div class='ad box'>x</div><p style='color:red; display : none'>hidden</p>"
    got = extract(spark, [(1, "u", page(f"<article><h1>t</h1>{inside}{gone}</article>"), ""), (2, "u", page(f"<div><p>t</p></div><div class='share-price'>beside</div>"), "")])
    assert got[1].text == "t price hint story" and got[2].text == "t"


def test_the_tree_measures_frames_by_articles(spark):
    """Teasers from a pool, on a host whose articles hardly repeat, leave its pages without an article too; headings stay."""
    rng = random.Random(5)
    pool = [f"teaser {k}" for k in range(12)]
    own = [" ".join(str(rng.random()) for _ in range(4)) for _ in range(60)]
    teaser = lambda: f"<div class=teaser>{rng.choice(pool)}</div>"
    rows = [(k, "http://i.example/p", page(f"{teaser()}<article><h1>head {k % 30}</h1><p>{own[k]}</p></article>"), "") for k in range(50)]
    rows += [(k, "http://i.example/p", page(f"{teaser()}<div class=body><h1>head {k % 30}</h1><p>{own[k]}</p></div>"), "") for k in range(50, 60)]
    got = extract(spark, rows)
    assert all(got[k].text == f"head {k % 30} {own[k]}" for k in range(60))
    nodes = html.site_nodes(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    importance = {r.node: r.importance for r in nodes.collect()}[">html>body>div.teaser"]
    assert html.LOW < importance
    assert [r.low for r in html.low_nodes(nodes).collect()] == [[">html>body>div.teaser"]]


def test_deep_nesting_is_no_square():
    import time

    began = time.time()
    found = html.Page("<div>" * 100_000 + "deep" + "</b>" * 100_000 + "</div>" * 100_000)
    assert [b[3] for b in found.blocks] == ["deep"] and time.time() - began < 20
