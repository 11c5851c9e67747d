import html

from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.functions.entities import decode_entities


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


def test_entities_match_standard_library(spark):
    samples = ["a &amp; b", "&amp;lt;", "&copy 2020 &middot; &am &nosuch; &eacute", "&#65;&#x42;&#128;&#8364;&#x1F600;&#0;", "& && &; &#;",
               "&nbsp;x&hellip;&amp", "&#99999999999;&#xD800;", "plain", "", "&amp"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    for r in df.select("v", decode_entities(F.col("v")).alias("d")).collect():
        assert r.d == html.unescape(r.v), r.v


def test_tokens_cover_the_page(spark):
    page = ("<!DOCTYPE html><p class=\"a>b\">x < y<!-- <p> --><script>var t=\"</p>\";</script>1<2"
            "<a href='q'>z</a><a title=\"broken>w</a> tail <b")
    got = one(spark, page, markup.tokens)
    assert got == ["<!DOCTYPE html>", '<p class="a>b">', "x < y", "<!-- -->", "<!-- -->", "1<2", "<a href='q'>", "z", "</a>",
                   '<a title="broken>', "w", "</a>", " tail ", "<b"]


def test_long_tags_do_not_overflow(spark):
    page = "<p " + "x" * 200_000 + ">text " + "<" * 50_000 + " end"
    assert len(one(spark, page, markup.tokens)) == 2


def test_attributes(spark):
    token = "<a title=\"x class=no\" CLASS='one two' href=/p?a=1&amp;b=2 id>"
    attrs = markup.attribute
    assert one(spark, token, lambda c: attrs(c, "class")) == "one two"
    assert one(spark, token, lambda c: attrs(c, "href")) == "/p?a=1&amp;b=2"
    assert one(spark, token, lambda c: attrs(c, "id")) == ""
    assert one(spark, token, lambda c: attrs(c, "a")) is None
    for squeezed in ("<div class='a'id=b>", "<DIV\nid = b class>", "<div/id='b'/>", "<div '' x= y id=b>"):
        assert one(spark, squeezed, lambda c: attrs(c, "id")) == "b"
    assert one(spark, "<b>", lambda c: attrs(c, "id")) is None


def test_lines(spark):
    raw = "  a   b\r\n\n  \n c d\x1fe "
    lines = [" ".join(line.split()) for line in raw.splitlines()]
    assert one(spark, raw, text.tidy_lines) == "\n".join(line for line in lines if line)
    assert one(spark, raw, text.word_count) == len(raw.split())
    assert one(spark, raw, text.strip) == raw.strip()
