"""Main text of pages."""

import re
import time

import pytest
from pyspark.sql import functions as F

from payloom.llm import html_text as H
from payloom.llm import registry


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_blocks_noise_and_references():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use</div><nav><ul><li>x<li>y</ul></nav><article><h1>A &amp; B</h1><p><b>un\nclosed<br><p>two &lt;3 <button>Press</button></p><div class="share">s</div><section id="comments"><p>c</p></section></article><aside>a</aside><footer>f'
    assert H.main_text(page, frozenset()) == "A & B\n\nun closed\n\ntwo <3"
    assert H.main_text("", frozenset()) == "" and H.main_text("plain text", frozenset()) == "plain text"
    assert H.main_text("<p>a<script>x", frozenset()) == "a" and H.main_text("a<!-- b", frozenset()) == "a"
    assert H.main_text("<p>a</div></b>b<p>c", frozenset()) == "ab\n\nc"
    assert H.main_text('<p title="a > b">x</p><p title=\'open>y</p><p>z', frozenset()) == "x\n\ny\n\nz"


@pytest.mark.parametrize("page", ["<a '" * 250_000, "<a b='>'" * 100_000, "<script " * 100_000, "<div>x" * 100_000, "<b>x" * 100_000, "<!--" * 200_000, '<p a="' * 150_000, "<" * 1_000_000])
def test_long_pages_take_linear_time(page):
    began = time.perf_counter()
    H.main_text(page, frozenset())
    assert time.perf_counter() - began < 20


def test_templates_of_a_site_go(spark):
    page = "<body><div class='top'>Welcome to the site</div><div class='body'><p>Story {0} is told here.</p><p>A shared line.</p></div><div class='links'><a href='/1'>one{0}</a><a href='/2'>two</a></div></body>"
    rows = [(i, f"http://site.example/{i}", page.format(i * 37)) for i in range(12)] + [(99, "http://lone.example/", page.format(5)), (100, None, page.format(6)), (101, "no url", None), (0, "http://site.example/0", page.format(0))]
    pages = pages_of(spark, rows).withColumns({"host": F.lit("x"), "removed": F.lit("x"), "path": F.lit(1)})
    got = {}
    for r in H.extract(pages.drop("removed", "host")).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Story 111 is told here.\n\nA shared line."] and len(got[0]) == 2
    assert got[99] == ["Welcome to the site\n\nStory 5 is told here.\n\nA shared line.\n\none5two"] and got[100][0].startswith("Welcome") and got[101] == [""]
    assert H.extract(pages.where("false").select("page_id", "url", "html")).count() == 0


def test_the_tree_alone_removes_templates(spark, monkeypatch):
    """Without any prior: menus, notices and footers with telling names go because they repeat, and only then."""
    monkeypatch.setattr(H, "prior", lambda path: 1.0)
    monkeypatch.setattr(H, "in_article", lambda path: False)
    page = "<body><nav><ul><li>Home<li>News<li>Contact</ul></nav><div class='cookie-notice'><p>We use cookies</p></div><article><h1>Title {0}</h1><p>Story {0} is told.</p>{1}</article><footer>All rights, 2020</footer></body>"
    pages = pages_of(spark, [(i, f"http://site.example/{i}", page.format(i, "<p>more</p>" * (i % 5))) for i in range(40)])
    texts = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert texts[5] == "Title 5\n\nStory 5 is told." and texts[6].startswith("Title 6\n\nStory 6 is told.\n\nmore")
    assert {r.page_id: r.text for r in H.extract(pages.where("page_id < 2")).collect()}[1].startswith("Home\n\nNews")


def test_every_given_page_has_a_tree_and_its_article(spark):
    """By string search: the blocks of each page's article; and the tree removes branches of every host."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tree = H.style_tree(pages.select(H.host_of("url").alias("host"), "html"))
    hosts = pages.select(H.host_of("url").alias("host")).distinct().count()
    assert tree.select("host").distinct().count() == hosts
    assert H.removed_branches(tree).where("size(removed) >= 3").count() >= 0.8 * hosts
    import html

    for r in registry.op5_html_text(spark, "/root/testdata/sf0.01").join(pages.select("page_id", "html"), "page_id").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = re.split(r"</?(?:article|h1|p)>", re.sub(r"<!--.*?-->|<script.*?</script>", "", inside, flags=re.S))
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in parts]
        assert r.text.replace(" ", "") == "\n\n".join(x for x in want if x).replace(" ", "") and r.n_chars == len(r.text)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "old", "h")], "page_id long, url string, html string, text string, host string")
    out = H.extract(pages)
    assert out.columns.count("text") == 1 and out.first().text == "x" and out.first().host == "h"


def test_templates_inside_articles_go(spark):
    page = "<body><article><div class='x'>Read this first</div><p>Story {0} is told here.</p><p>A shared line.</p><div class='y'><a href='/1'>one{0}</a></div></article></body>"
    pages = pages_of(spark, [(i, f"http://site.example/{i}", page.format(i * 37)) for i in range(12)])
    assert {r.page_id: r.text for r in H.extract(pages).collect()}[3] == "Story 111 is told here.\n\nA shared line."
