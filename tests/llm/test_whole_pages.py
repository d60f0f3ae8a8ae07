"""Wrapper induction on small hosts and several layouts, furniture by whole marks, heads without an end."""

import pytest

from retailforge.llm import common, wrapper
from tests.conftest import spark  # noqa: F811,F401


def texts(spark, pages):  # noqa: F811
    common.prepare(spark)
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, page struct<url:string,html:string>").select("page_id", "page.*")
    return {r.row.page_id: r.text for r in wrapper.extract(df).collect()}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_small_hosts_have_templates(spark, n):  # noqa: F811
    pages = [(f"http://s.example/{i}", f"<body><div class=main><h2>title {i}</h2><p>own words {i} of it</p><p>Read our terms before you go.</p></div></body>")
             for i in range(n)]
    pages += [("http://copy.example/1", "<p>same</p><p>text</p>"), ("http://copy.example/2", "<p>same</p><p>text</p>"),
              ("http://copy.example/3", "<nav>x</nav><p>same</p><p>text</p>")]
    got = texts(spark, pages)
    assert all(got[i] == f"title {i}\nown words {i} of it" for i in range(n))
    assert all(got[i] == "same\ntext" for i in range(n, n + 3))  # equal content is one page


def test_each_layout_has_its_template(spark):  # noqa: F811
    pages = [(f"http://two.example/{i}", f"<body><div class=wide><p>Boiler of the wide pages</p><p>text {i} here</p></div></body>" if i % 2 else
              f"<body><section><div class=narrow><p>Line on narrow ones</p><p>text {i} here</p></div></section></body>") for i in range(40)]
    assert set(texts(spark, pages).items()) == {(i, f"text {i} here") for i in range(40)}


def test_a_long_constant_is_template(spark):  # noqa: F811
    notice = " ".join(f"word{i % 7}" for i in range(90))
    pages = [(f"http://long.example/{i}", f"<div><p>{notice}</p><p>page {i}</p></div>") for i in range(6)]
    assert set(texts(spark, pages).values()) == {f"page {i}" for i in range(6)}


@pytest.mark.parametrize("html, text", [
    ('<div class="content no-sidebar"><p>kept</p></div>', "kept"),
    ('<article><div class="entry-header"><h1>Head</h1></div><p>body</p></article>', "Head\nbody"),
    ('<div id="related-work"><p>kept</p></div>', "kept"),
    ('<article class="article social"><p>kept</p></article>', "kept"),
    ('<div class="social"><article><p>kept</p></article></div>', "kept"),
    ('<div class="site-footer">gone</div><p>kept</p>', "kept"),
    ('<div id="ad-slot-3">gone</div><div class="cookie-banner">gone</div><p>kept text of the page</p>', "kept text of the page"),
    ('<article><p>short</p></article><div class="comments"><p>very long comments of many readers, longer than the page itself</p></div>', "short"),
    ("<html><head><meta charset=utf-8><title>t</title><body><p>kept</p>", "kept"),
    ("<head><title>t</title><style>p{}</style><p>kept</p>", "kept"),
    ("<title>only a title</title><p>kept</p>", "kept"),
    ("<title>open title<p>kept</p>", "kept"),
    ("", ""), ("<div></div>", ""), ("<p>a &amp;amp; b&nbsp;c", "a &amp; b c"),
])
def test_furniture_and_heads(html, text):
    assert "\n".join(b["text"] for b in wrapper._blocks_of(html, None)[1] if not b["chrome"]) == text
