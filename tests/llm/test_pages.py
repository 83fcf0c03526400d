"""Main text on pages that the training pages' maker did not write: by hand, and the test data's."""

import html
import re
import sys

import duckdb
import pytest

from axolin.llm import html_text

BLOG = """<!doctype html><html><head><title>T</title><link rel=x></head><body class="home blog">
<div id="page"><div id="masthead" class="site-header"><p class="site-title"><a href="/">The Gardener</a></p>
<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">About</a></li><li><a href="/c">Archive</a></li></ul></div>
<div id="content" class="site-content"><div class="post hentry"><h1 class="entry-title">Growing tomatoes from seed</h1>
<div class="entry-content"><p>Start the seeds indoors six weeks before the last frost, in small pots with fine soil.</p>
<p>Water them from below, so that the stems stay dry. A <a href="/lamp">lamp</a> helps in dark rooms.</p>
<h2>Moving them outside</h2><ul><li>Wait until the nights are mild.</li><li>Harden the plants for a week.</li></ul>
<blockquote><p>My grandmother never planted before the middle of May.</p></blockquote></div></div></div>
<div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Pruning roses</a></li><li><a href="/2">Compost</a></li></ul></div>
<div id="colophon" class="site-footer"><p>Copyright 2020 The Gardener. All rights reserved.</p></div></div></body></html>"""
BLOG_TEXT = "Growing tomatoes from seed|Start the seeds indoors six weeks before the last frost, in small pots with fine soil.|Water them from below, so that the stems stay dry. A lamp helps in dark rooms.|Moving them outside|Wait until the nights are mild.|Harden the plants for a week.|My grandmother never planted before the middle of May."

NEWS = """<html lang=en><body><header role=banner><a href=/>Daily Courier</a><nav><a href=/w>World</a> <a href=/s>Sport</a> <a href=/m>Money</a></nav></header>
<main><article itemscope><h1>River reaches highest level in forty years</h1>
<p>The river rose by two metres overnight and reached its highest level since records were digitised, the water board said on Tuesday.</p>
<aside class="related"><h4>Related</h4><a href=/x>Last year's floods</a></aside>
<p>Residents of the lower town were asked to move their cars to higher ground.</p>
<div class="advert">Advertisement: buy boots now at half the price!</div>
<p>"We have never seen anything like it," said one of them.</p></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Stay safe everyone, it is wet out there.</p></div><div class="comment"><b>Bob</b><p>It was worse in my day.</p></div></section></main>
<div class="cookie-banner"><p>We use cookies to improve your visit. Read our policy.</p><button>Accept</button></div>
<footer><p>Contact us &middot; Imprint</p></footer></body></html>"""
NEWS_TEXT = "River reaches highest level in forty years|The river rose by two metres overnight and reached its highest level since records were digitised, the water board said on Tuesday.|Residents of the lower town were asked to move their cars to higher ground.|\"We have never seen anything like it,\" said one of them."

MATHS = """<title>Energy</title><body><nav><ul><li><a href=1>Previous</a><li><a href=2>Next</a></ul></nav><article><h1>Mass and energy</h1>
<p>The relation <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation encoding="application/x-tex">E=mc^2</annotation></math> holds for a body at rest.
<p>The figure <svg viewBox="0 0 1 1"><title>icon</title><path d="M0 0"/><text>A to B</text></svg> shows it.</article><footer>&copy; 2021 somebody</footer>"""
MATHS_TEXT = "Mass and energy|The relation E=mc2 holds for a body at rest.|The figure A to B shows it."

OLD = """<HTML><BODY><TABLE><TR><TD CLASS=nav><A HREF=a>Home</A><BR><A HREF=b>Links</A><BR><A HREF=c>Guestbook</A></TD><TD CLASS=content>
<H1>My trip to the mountains</H1><P>We left early in the morning, long before the sun rose over the valley.<P>The path was steep, but the view from the hut made up for it. We stayed for two nights.
</TD></TR></TABLE></BODY></HTML>"""
OLD_TEXT = "My trip to the mountains|We left early in the morning, long before the sun rose over the valley.|The path was steep, but the view from the hut made up for it. We stayed for two nights."

PAGES = {"blog": (BLOG, BLOG_TEXT), "news": (NEWS, NEWS_TEXT), "formulas": (MATHS, MATHS_TEXT), "old": (OLD, OLD_TEXT)}


def test_pages_written_by_hand():
    got = dict(zip(PAGES, html_text.main_texts([p for p, _ in PAGES.values()], html_text.trained()), strict=True))
    want = {k: t.split("|") for k, (_, t) in PAGES.items()}
    right = sum(len([b for b in got[k].split("\n") if b in want[k]]) for k in PAGES)
    missed = {k: [b for b in want[k] if b not in got[k].split("\n")] for k in PAGES}
    extra = {k: [b for b in got[k].split("\n") if b not in want[k]] for k in PAGES}
    assert right >= 17 and sum(map(len, extra.values())) <= 2, (missed, extra)
    assert got["formulas"].split("\n") == want["formulas"]


def article(page):
    """The blocks of the article of a page of the test data, by its own plain markup."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a)[^r>]*>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_pages_of_the_test_data(name):
    rows = duckdb.connect().execute(f"SELECT html FROM '/root/testdata/{name}/pages.parquet' WHERE html IS NOT NULL").fetchall()
    got = html_text.main_texts([r[0] for r in rows], html_text.trained())
    assert len(rows) > 20 and sum(g == article(r[0]) for g, r in zip(got, rows, strict=True)) == len(rows)


def test_steps_grow_with_the_length_alone():
    """Counted in executed lines of the module, which no machine changes."""

    def steps(page):
        n = 0

        def line(frame, event, arg):
            nonlocal n
            n += event == "line"
            return line

        sys.settrace(lambda frame, event, arg: line if frame.f_code.co_filename == html_text.__file__ else None)
        try:
            nodes = html_text.nodes_of(html_text.parse(page))
            html_text.decode(nodes, html_text.features(nodes)[:, 0])
        finally:
            sys.settrace(None)
        return n

    for part in ("<h1>", "<div>x", "<p>a</b>", "<svg><svg>", "<li><ul>", "<select>", "</x>", "<a>", "<tr><td>"):
        assert steps(part * 4_000) < 8.2 * steps(part * 500), part


def test_rows_and_columns(spark):
    page = "<article><p>Hello there, this is the text of the page, and it is long enough.</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "y"), (2, None, None, "z"), (None, "v", "", None), (3, "w", "<p>" * 3 + "word " * 200_000, "t")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars", "2 AS tag", "3 AS `a.b`")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(docs).collect()), key=str)
    assert len(got) == 5 and got.count((1, "u", "Hello there, this is the text of the page, and it is long enough.", 65)) == 2
    assert (2, None, "", 0) in got and (None, "v", "", 0) in got and all(n == len(t) for _, _, t, n in got)
    assert html_text.extract(docs.limit(0)).count() == 0
