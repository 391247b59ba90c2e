import os
import re

import numpy as np
import pytest

from clauseriver.llm import html_extract, vp_search
from clauseriver.llm.html_extract import best_page, extract_main

SF = "/root/testdata/sf0.001"

ARTICLE = "<h1>The title</h1><p>First para &amp; more&nbsp;text, long enough to count.<p>Second <b>bold<br>line</p><ul><li>one<li>two</ul>"
TEXT = "The title\nFirst para & more text, long enough to count.\nSecond bold line\none\ntwo"
TAG = re.compile("<[^>]*>")
PAGES = {
    "article": f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><article>{ARTICLE}</article><footer>foot</footer></body></html>",
    "div": f"<body><div id=top><header><h2>Site</h2></header><div class='menu main'><ul><li>a<li>b</ul></div><div class='post post-17'>{ARTICLE}<form><input>mail</form><aside>see also</aside><div class='ad-box'>buy</div></div><div class='comments'><div><p>nice one</p></div></div></div>",
    "raw": f"<body><div class=x><script>var a='</p><article>no</article>';</script>{ARTICLE}<!-- <p>gone</p> --></div><div class='cookie-notice'>we use cookies</div><div style='display: none'>hidden</div>",
    "upper": f"<BODY><MAIN>{TAG.sub(lambda m: m[0].upper(), ARTICLE)}</MAIN><DIV CLASS=SIDEBAR>side</DIV></BODY>",
    "nested": f"<body><div class=wrap><nav><div><div>deep</div></div></nav><section>{ARTICLE}</section><section class='related'><p>more of it</p></section></div>",
    "marks": f"<body class='has-comments'><div class='layout with-sidebar'><article class='post no-sidebar'>{ARTICLE}<div id=cookieConsent>ok?</div><div class=commentList><p>hm</p></div></article><article class='comment'>so so</article><div id='rightSidebar'>x</div></div>",
    "commentary": f"<body><div class='commentary'>{ARTICLE}</div><div class='advertising'>buy</div><div role='navigation'>go</div><p class=notice>note</p>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(spark, name):
    df = spark.createDataFrame([(1, f"http://{name}.example/1", PAGES[name], "clash")], "page_id long, url string, html string, text string")
    row = html_extract.extract_main(df).collect()[0]
    assert row["text"] == TEXT and row["n_chars"] == len(TEXT)


def test_hosts_vote(spark):
    page = lambda main, side: f"<body><div class='alpha content'><p>{main}</p></div><div class='beta content'><p>{side}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page("main text " * 30, "side " * 5)) for i in range(30)]
    rows.append((99, "http://h.example/99", page("short main", "an unusually long side bar text " * 9)))
    rows.append((100, "nowhere", page("short main", "an unusually long side bar text " * 9)))
    out = {r["page_id"]: r["text"] for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == ("main text " * 30).strip()
    assert out[99] == "short main"
    assert "side bar" in out[100]


def test_salted_join_agrees(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", list(PAGES.values())[i % len(PAGES)]) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = sorted(map(tuple, html_extract.extract_main(df).collect()))
    assert sorted(map(tuple, html_extract.extract_main(df, most_broadcast=-1).collect())) == small


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/", "plain words"), (3, "http://a.b/", "plain words"), (None, "http://a.b/x", "<p>" + "long " * 50_000), (5, "http://a.b/", "<<< a < b &lt; &#233; <p <div>"), (6, "http://a.b", "<div>" * 3000 + "deep")]
    out = html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r["page_id"], r["text"]) for r in out if r["page_id"] in (1, 2, 3, 6)))
    assert got == [(1, ""), (2, ""), (3, "plain words"), (3, "plain words"), (6, "deep")]
    assert [r["n_chars"] for r in out if r["page_id"] is None] == [50_000 * 5 - 1]
    assert html_extract.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_doubtful_parts_go_only_if_the_host_agrees(spark):
    body = lambda i, extra: f"<body><article><h1>t{i}</h1><p>{'words ' * 30}</p>{extra}</article></body>"
    box, work = "<div class='related'><p>see also</p></div>", "<div class='related-work'><p>others wrote</p></div><section id='discussion'>we think</section><label>named</label>"
    rows = [(i, f"http://many.example/{i}", body(i, box if i != 3 else box + work)) for i in range(9)] + [(50, "http://one.example/", body(50, work))]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    words = ("words " * 30).strip()
    assert out[0] == f"t0\n{words}"
    assert out[3] == f"t3\n{words}\nothers wrote\nwe think\nnamed"
    assert out[50] == f"t50\n{words}\nothers wrote\nwe think\nnamed"


@pytest.mark.parametrize("page", ["<a " * 330_000, "<script " * 120_000, "<!" * 500_000, "<div>" * 200_000, "<a '" * 250_000, "<div><p>x</em>" * 70_000])
def test_long_pages_take_little(page):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.process_time()
    html_extract.Page(page)
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def plain_article(page):
    """The tables' pages by another parser: all blocks inside article, but for what stands in a dropped element."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.out, self.text = 0, [], ""

        def end_block(self):
            if self.depth and self.text.split():
                self.out.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text += " "
            elif tag not in ("b", "i", "em", "strong", "a", "span"):
                self.end_block()
                self.depth += tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "em", "strong", "a", "span"):
                self.end_block()
                self.depth -= tag == "article"

        def handle_data(self, data):
            self.text += data if self.depth else ""

    reader = Reader()
    reader.feed(page)
    reader.end_block()
    return "\n".join(reader.out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_the_tables_pages_by_another_parser(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = {r["page_id"]: r["text"] for r in html_extract.op2_html_extract(spark, SF).collect()}
    assert out == {k: plain_article(h) for k, h in html.items()}


# -- search


def brute(ids, x, k):
    out = {}
    for q in sorted(set(i for i in ids if i % 20 == 0)):
        v = x[ids.index(q)]
        cand = sorted(((-round(float(np.dot(v, y)), 9), i) for i, y in zip(ids, x, strict=True) if i != q))
        out[q] = [i for _, i in cand[:k]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = vp_search.valid_vectors(df)
    out = {}
    for r in sorted(vp_search.search(v, v.where("vec_id % 20 = 0"), **kw).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for found in out.values():
        assert [k for k, _ in found] == list(range(1, len(found) + 1))
    return {q: [i for _, i in f] for q, f in out.items()}


def vectors(n, d=16, seed=0, clusters=20):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d)) * 3
    return (centers[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))).astype(np.float32).astype(float)


def test_factor_one_is_exact(spark):
    x = vectors(900)
    x[100:160] = x[100]  # many equal vectors: ties go to the smaller id
    ids = list(range(900))
    got = run(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], factor=1.0, shard_rows=200, block_queries=10, leaf=16)
    assert got == brute(ids, x, 20)


def test_recall_of_the_production_factor(spark):
    x = vectors(3000, 32, clusters=100)
    ids = list(range(3000))
    got, expected = run(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]), brute(ids, x, 20)
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


@pytest.mark.parametrize("times", [20, 50, 1000])
def test_recall_beside_a_few_long_vectors(times):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[[7, 40, 1111]] *= times  # 40 is a query too
    x[60] /= times
    ids = list(range(3000))
    expected = brute(ids, x, 20)
    asked = np.array(sorted(expected))
    shard = vp_search.Shard(np.arange(3000), np.arange(3000), x, vp_search.LEAF)
    q, rows, _ = vp_search.Search(shard, asked, x[asked], 20, vp_search.FACTOR).found()
    recall = [len(set(rows[q == k]) & set(expected[i])) / 20 for k, i in enumerate(asked.tolist())]
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.5


def test_pruning_passes_branches_over():
    x = vectors(4000, 8, clusters=200)
    seen = []
    scan = vp_search.Search.scan
    try:
        vp_search.Search.scan = lambda self, rows, asked: (seen.append(len(rows) * len(asked)), scan(self, rows, asked))[1]
        for factor in (1.0, 2.0):
            seen.append(None)
            vp_search.Search(vp_search.Shard(np.arange(4000), np.arange(4000), x, 32), np.arange(50), x[:50], 20, factor)
    finally:
        vp_search.Search.scan = scan
    second = len(seen) - 1 - seen[::-1].index(None)
    exact, relaxed = sum(seen[1:second]), sum(seen[second + 1 :])
    assert relaxed < exact < 50 * 4000


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0, 3.0], 0), (1, [0.5, 0.5], 0), (20, [], 0), (40, [-1.0, 0.0], 0)]
    assert run(spark, rows) == {0: [1, 1, 40], 40: [1, 1, 0]}  # rows of one vec_id are candidates each
    assert run(spark, []) == {}


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e200])
def test_scales(spark, scale):
    x = vectors(400, clusters=5)
    x[100:130] = x[100]
    rows = [(i, (v * scale).tolist()) for i, v in enumerate(x)]
    v = vp_search.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in sorted(vp_search.search(v, v.where("vec_id % 20 = 0"), factor=1.0, shard_rows=150, leaf=16).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.dot(x[r["query_id"]], x[r["vec_id"]])) * scale * scale if scale < 2 else float("inf"))
    assert got == brute(list(range(400)), x, 20)


def test_many_queries_and_rows_of_one_id(spark):
    x = vectors(300)
    rows = [(i % 100, v.tolist(), 0) for i, v in enumerate(x)]
    v = vp_search.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    out = vp_search.search(v, v.where("vec_id % 20 = 0"), factor=1.0, shard_rows=70, block_queries=4, leaf=16).collect()
    expected = []
    for q, y in enumerate(x):
        if q % 100 % 20 == 0:
            near = sorted((-float((y * z).sum()), i % 100) for i, z in enumerate(x) if i != q)[:20]
            expected += [(q % 100, k, i) for k, (_, i) in enumerate(near, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == sorted(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_the_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    expected = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        expected[ids[q]] = [(int(ids[i]), scores[i]) for i in np.lexsort((ids, -scores))[:20]]
    hits, n = 0, 0
    for r in vp_search.op1_vp_search(spark, SF).collect():
        hits += r["vec_id"] in {i for i, _ in expected[r["query_id"]]}
        assert r["score"] == pytest.approx(float((x[ids == r["vec_id"]][0] * x[ids == r["query_id"]][0]).sum()), rel=1e-12)
        n += 1
    assert n == sum(map(len, expected.values())) and hits / n >= 0.9


ART = "<article><p>The first paragraph of it.</p><p>And a second one.</p></article>"
WHOLE = "The first paragraph of it.\nAnd a second one."


@pytest.mark.parametrize("wrap", ["overflow-hidden", "comments-on-law", "footer-less", "sidebar-free", "sponsors-of-the-bill", "popup-magnifier", "sidebar", "hidden-gems"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_wrapper_keeps_its_article(wrap, kind):
    for html in (f'<div {kind}="{wrap}">{ART}</div>', f'<body><nav>Home</nav><div {kind}="{wrap}"><form>{ART}<button>Send</button></form></div><footer>End</footer></body>'):
        page = best_page(html)
        assert "\n".join(page.blocks[page.firsts[0] : page.ends[0]]) == WHOLE


@pytest.mark.parametrize("part", [
    '<p title="hidden gems">Kept part.</p>', '<p data-hidden="false">Kept part.</p>', '<p onclick="hidden=1">Kept part.</p>', "<p data-x='class=\"sidebar\"'>Kept part.</p>",
    '<section class="login-howto"><p>Kept part.</p></section>', '<section id="comments-on-law"><p>Kept part.</p></section>', '<div class="sponsors-of-the-bill">Kept part.</div>',
    '<div class="sidebar-free">Kept part.</div>', "<p><math>Kept part.</math></p>",
])
def test_parts_of_an_article_stay(spark, part):
    html = f"<body><article><p>Before it all.</p>{part}<p>After it all.</p></article></body>"
    df = spark.createDataFrame([(1, "http://one.example/a", html)], "page_id long, url string, html string")
    assert extract_main(df).collect()[0]["text"] == "Before it all.\nKept part.\nAfter it all."


@pytest.mark.parametrize("part", ['<div class="sidebar">x y</div>', '<p hidden>x y</p>', "<p HIDDEN=''>x y</p>", '<div class="site-footer">x y</div>', '<div id="cookieBanner">x</div>', '<section class="comments">z</section>', '<p style="display: none">x</p>', '<p class="hidden">x</p>'])
def test_boilerplate_goes(part):
    page = best_page(f"<body><article><p>Before it all.</p>{part}<p>After it all.</p></article></body>")
    assert page.blocks == ["Before it all.", "After it all."]


def test_wrapper_and_sidebar_of_one_word(spark):
    """A host whose articles stand in a noisy wrapper, beside a true sidebar, and one whose articles repeat a hinted part."""
    side = '<div class="sidebar"><p>Links and more links</p></div>'
    hint = '<div class="sidebar-offer"><p>Buy now</p></div>'
    pages = [(i, f"http://a.example/{i}", f'<body><div class="sidebar-layout"><div class="sidebar">{side}{ART}</div></div></body>') for i in range(4)]
    pages += [(10 + i, f"http://b.example/{i}", f"<body><article><p>Page {i} says this.</p>{hint}<p>And that.</p></article></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [WHOLE] * 4
    assert [got[10 + i] for i in range(4)] == [f"Page {i} says this.\nAnd that." for i in range(4)]
