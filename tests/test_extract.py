"""Extraction on hand-made pages with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.operators.extract import extract_fields, link_lists, page_links

ARTICLE = """<!doctype html><html lang="en"><head><meta charset="utf-8">
<title>Reading a tide table | Delta Wardens</title>
<meta content="How to read a tide table" name="description"><meta name="author" content="M. Ruiz"></head>
<body><header>Delta Wardens</header>
<nav><ul><li><a href="/stations">Stations</a></ul></nav>
<article><h1>Reading a tide table</h1>
<p>Low water comes twice
a day, <em>an hour later</em> each time.</p>
<p>See <a href="../charts?lang=en">the charts</a> and <a href="https://sea.example.net/">the sea</a>.</p></article>
<footer>Lock 4, North Bank</footer></body></html>"""

# name -> (html, title, body lines)
PAGES = {
    "article": (ARTICLE, "Reading a tide table", [
        "Reading a tide table", "Low water comes twice", "a day,", "an hour later", "each time.", "See", "the charts", "and", "the sea", "."]),
    "inline_breaks": ("<body><p>one <b>two</b> three</p></body>", "", ["one", "two", "three"]),
    "siblings": ("<body>x<section><article>a</article><article>b</article>tail</section>y</body>", "", ["a", "b", "tail"]),
    "single_article": ("<body>x<section><article>a</article></section>y</body>", "", ["a"]),
    "empty_main_skipped": ("<body><main> &nbsp; </main><article>a</article>z</body>", "", ["a"]),
    "only_first_match": ("<body><article></article><div><article>b</article></div><div class=post>p</div></body>", "", ["p"]),
    "selector_order": ("<body><div id=post>i</div><div class='x post'>c</div><p role=main>r</p></body>", "", ["r"]),
    "body_fallback": ("<head><title>T</title></head><body>b</body>", "T", ["b"]),
    "no_tags": ("just text &amp; more", "", ["just text & more"]),
    "cut_off": ("<html><head><title>T</title></head><body><article>a</article><article>b</article>", "T", ["a", "b"]),
    "nested_noise": ("<body>k<div class=sidebar>s<div>t</div>u</div>v<nav><nav>n</nav>m</nav>w</body>", "", ["k", "v", "w"]),
    "stray_closer": ("<body><main>a</div></p>b</main>c</body>", "", ["a", "b"]),
    "unclosed_noise": ("<body><div>a<nav>n</div>b</body>", "", ["a", "b"]),
    "implied_item": ("<body><ul><li class=menu>m<li>k</ul>z</body>", "", ["k", "z"]),
    "implied_nested": ("<body><ul><li>a<ul><li class=nav>n</ul>b<li>c</ul></body>", "", ["a", "b", "c"]),
    "implied_paragraph": ("<body><p class=widget>w<p>a<div>b</div></body>", "", ["a", "b"]),
    "paragraph_ends_at_block": ("<body><p id=cookie>w<div>b</div></body>", "", ["b"]),
    "implied_cells": ("<body><table><tr><td class=social>s<td>t<tr><td>u</table></body>", "", ["t", "u"]),
    "script_text": ("<body><script>var a='</p><main>';</script>a<!-- <main>c</main> -->b</body>", "", ["a", "b"]),
    "title_first_part": ("<title>Self-Study Guide</title><body>b</body>", "Self", ["b"]),
    "title_blank": ("<title>  </title><body><h1>H</h1></body>", "", ["H"]),
    "title_missing": ("<body><h1> A <i> b </i>c</h1></body>", "Abc", ["A", "b", "c"]),
    "title_entities": ("<head><title>A &amp; B | C</title></head><body>b</body>", "A & B", ["b"]),
    "unread": ("<body><ruby>k<rt>r</rt></ruby><template>t</template>z</body>", "", ["k", "z"]),
    "quoted_gt": ("<body><p title='a>b'>c</p></body>", "", ["c"]),
    "escaped_markup": ("<body>&lt;b&gt; x &amp;lt;</body>", "", ["<b> x &lt;"]),
    "div_with_dots": ("<body><div class=\"content-main\">x</div><div class='a content'>y</div></body>", "", ["y"]),
}
EMPTY = {
    "has_sidebar": "<body class=has-sidebar><p>text</p></body>",
    "blank": "<body> <p> </p></body>",
    "empty": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(n, "https://example.com/a/", p[0]) for n, p in PAGES.items()]
    rows += [(n, "https://example.com/a/", h) for n, h in EMPTY.items()]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    return {r.page_id: r for r in extract_fields(pages).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_fields(parsed, name):
    html, title, lines = PAGES[name]
    row = parsed[name]
    assert row.body_text.split("\n") == lines
    assert row.title == title
    assert row.html_length == len(html)


def test_pages_without_text_give_no_row(parsed):
    assert not set(EMPTY) & set(parsed)


def test_meta(parsed):
    assert parsed["article"].meta == {"description": "How to read a tide table", "author": "M. Ruiz"}
    assert parsed["no_tags"].meta == {}


def test_meta_first_match_and_empty_content(spark):
    html = ("<head><meta name=author content=''><meta name=author content=B><meta name=keywords content=' k, l '>"
            "<meta property='og:title' content='O &amp; P'><meta name=Description content=no></head><body>x</body>")
    pages = spark.createDataFrame([(1, "http://h.com/", html)], "page_id long, url string, html string")
    assert extract_fields(pages).first().meta == {"keywords": "k, l", "og_title": "O & P"}


@pytest.mark.parametrize("scope, expected", [
    ("cleaned", ["https://delta.example.org/charts?lang=en"]),
    ("raw", ["https://delta.example.org/stations", "https://delta.example.org/charts?lang=en"]),
])
def test_links(spark, scope, expected):
    pages = spark.createDataFrame([(1, "https://delta.example.org/guides/tides", ARTICLE)], "page_id long, url string, html string")
    rows = link_lists(page_links(pages, scope=scope, seed_domain="delta.example.org")).collect()
    assert rows[0].links_internal == expected


def test_link_rules(spark):
    html = ("<body><a href=''>self</a><a href='/x#f'>x</a><a href='/x'>again</a><a href='mailto:a@b'>m</a><a href='#t'>t</a>"
            "<a href='JavaScript:1'>j</a><a href='http://sub.example.com/'>s</a><a href='http://example.com:99999/'>p</a>"
            "<a name=n>n</a><a href='b?utm_source=1&amp;q=2'>b</a></body>")
    pages = spark.createDataFrame([(1, "http://example.com/d/p", html)], "page_id long, url string, html string")
    fields = extract_fields(pages.withColumn("fetched_at", F.current_timestamp()), keep=("url", "fetched_at"), links="cleaned").first()
    assert fields.links_internal == link_lists(page_links(pages, scope="cleaned")).first().links_internal
    raw = extract_fields(pages.withColumn("fetched_at", F.current_timestamp()), keep=("url", "fetched_at"), links="raw").first()
    assert raw.links_internal == link_lists(page_links(pages, scope="raw")).first().links_internal

    def get(scope):
        return link_lists(page_links(pages, scope=scope)).first().links_internal
    base = ["http://example.com/x", "http://example.com/d/b?q=2"]
    assert get("cleaned") == ["http://example.com/d/p", *base]
    assert get("raw") == base
    with pytest.raises(ValueError):
        page_links(pages, scope="other")


def test_a_link_is_made_once(spark, tmp_path):
    """Testing a link must not make it again: each making holds one call that encodes a query."""
    spark.createDataFrame([(1, "http://h.com/", "<a href=x>x</a>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    links = page_links(pages, scope="cleaned")
    once = pages.select(normalize_url(F.col("url")).alias("link"))
    calls = [df._jdf.queryExecution().optimizedPlan().toString().count("UrlCodec") for df in (once, links)]
    assert calls[0] == calls[1] > 0
