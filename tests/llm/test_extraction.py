from __future__ import annotations

import html as markup
import re

import numpy as np
import pytest

from tidemark.llm import boosting, dom, extraction
from tidemark.llm.queries import QUERIES


def brute(page):
    """The article of the test pages, which mark it plainly."""
    at = (page or "").find("<article>")
    if at < 0:
        return ""
    part = page[at:].split("</article>")[0]
    part = re.sub(r"<[A-Za-z/!][^<>]*$", "", part)
    blocks = re.split(r"</?(?:p|h1|article)>", part)
    texts = [" ".join(markup.unescape(re.sub(r"<[^<>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_plain_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_main_text"](spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages)
    wrong = [r.page_id for r in rows if r.text != brute(pages[r.page_id].html)]
    assert not wrong
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Site</a> The best site</header>
<ul class="menu"><li><a>Home</a><li><a>News</a></ul>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div>
<div id="content" class="post">
<h1>Title &amp; more</h1>
<p>First paragraph of the  article, with <b>bold</b> words&nbsp;and enough text to be one.
<p>Second paragraph &lt;here&gt; &#233; with some more sentences. It goes on. And on, for a while.</p>
<div class="ad">Buy things now, they are cheap.</div>
<p>Third paragraph, which ends the article with a last long sentence about nothing at all.</p>
<script>document.write("<p>no</p>")</script>
</div>
<aside class="sidebar"><h3>Related</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul></aside>
<form><label>Name</label><input><button>Send</button></form>
<section id="comments"><div class="comment"><b>Ann</b><p>I liked this text very much, it was long and good, and I read it all.</p></div></section>
<footer>&copy; Site</footer></body></html>"""

WANT = (
    "Title & more\n\nFirst paragraph of the article, with bold words and enough text to be one.\n\n"
    "Second paragraph <here> é with some more sentences. It goes on. And on, for a while.\n\n"
    "Third paragraph, which ends the article with a last long sentence about nothing at all."
)


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_other_layouts(model):
    features = dom.Features(model.tokens, model.tags)
    assert extraction.extract_pages(model, features, [PAGE]) == [WANT]
    other = PAGE.replace('<div id="content" class="post">', "<main>").replace("</script>\n</div>", "</script>\n</main>")
    assert extraction.extract_pages(model, features, [other]) == [WANT]


def test_held_out_layouts(model):
    """Pages built by the same layouts from texts the model has not seen."""
    rng = np.random.default_rng(99)
    texts = [" ".join(f"{chr(97 + int(c))}ord{int(n)}" for c, n in rng.integers(0, 20, (40, 2))) + "." for _ in range(40)]
    dresser, right, total = extraction._Dresser(texts, rng), 0, 0
    features = dom.Features(model.tokens, model.tags)
    for _ in range(60):
        root = dresser.page([("h1", "Some title here")] + [("p", dresser.pick(texts)) for _ in range(rng.integers(2, 9))])
        nodes = extraction.seen(root)
        chosen = extraction.decode(nodes, model.trees.probability(features.of(nodes)))
        right += sum((id(n) in chosen) == n.keep for n in nodes)
        total += len(nodes)
    assert right >= 0.95 * total


def test_decoding_is_the_best_of_all_choices():
    rng = np.random.default_rng(4)
    root = dom.parse("<div><p>a<b>b</b></p><p>c</p></div><div><p>d</p></div>")
    nodes = extraction.seen(root)
    for _ in range(50):
        p = rng.uniform(0.05, 0.95, len(nodes))
        best, found = -np.inf, None
        for bits in range(1 << (len(nodes) - 1)):
            keep = [True] + [bool(bits >> i & 1) for i in range(len(nodes) - 1)]
            at = {id(n): k for n, k in zip(nodes, keep)}
            if any(k and n.parent is not None and not at[id(n.parent)] for n, k in zip(nodes, keep)):
                continue
            score = sum(np.log(q if k else 1 - q) for q, k in zip(p[1:], keep[1:]))
            if score > best:
                best, found = score, {id(n) for n, k in zip(nodes, keep) if k}
        assert extraction.decode(nodes, p) == found


def test_broken_pages(model, spark):
    features = dom.Features(model.tokens, model.tags)
    texts = extraction.extract_pages(model, features, [None, "", "   ", "<", "<p", "</div></p>", "<!-- x", "&am"])
    assert texts[:3] == ["", "", ""] and len(texts) == 8
    assert extraction.extract_pages(model, features, ["<div>" * 3000 + "x"])
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article><p>a")], "page_id long, url string, html string")
    assert extraction.extract(pages, model).count() == 3
    assert extraction.extract(pages.limit(0), model).count() == 0


def test_training_without_marks(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (2, "v", None)], "page_id long, url string, html string")
    assert extraction.extract(pages, extraction.train(pages)).count() == 2
    assert extraction.extract(pages, extraction.train(pages.limit(0))).count() == 2


def test_trees_learn_a_rule():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500], rounds=20, depth=3)
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def texts_of(html):
    return dom.blocks(dom.parse(html), lambda n: n.tag not in dom.UNSEEN)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<head><title>T</title><p>Article text</p><p>More", ["Article text", "More"]),
        ("<title>T</title><meta charset=x><div>Text<p>More</div>", ["Text", "More"]),
        ("<head><link rel=x><script>var p;</script>Bare text <b>and</b> more", ["Bare text and more"]),
        ("<head><template><p>no</p></template><title>T</title></head><body><p>Yes", ["Yes"]),
        ("<body><p>x <math><mi>a</mi>=<mn>1</mn></math> <object data=f>fallback</object> <noscript>still</noscript>", ["x a=1 fallback still"]),
        ("<p>a < b and c <", ["a < b and c <"]),
        ("<p>cut off <a href=", ["cut off"]),
    ],
)
def test_pages_that_leave_out_tags(html, want):
    assert texts_of(html) == want


def test_many_siblings():
    import time

    nodes = dom.parse("<body>" + "<p>Some text here.</p>" * 20_000).nodes()
    began = time.perf_counter()
    rows = dom.Features({}, {}).of(nodes)
    assert len(rows) == len(nodes) and time.perf_counter() - began < 10
