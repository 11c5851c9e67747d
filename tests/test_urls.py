"""URL functions against the standard library's rules."""

import hashlib
from urllib.parse import parse_qs, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls

URLS = [
    "http://ththre.example.com/fr/825?page=2&ref=x",
    "HTTPS://User:pw@M.Example.NET:443/en/25#top",
    "http://h.com:80", "http://h.com:8080/a", "https://h.com:80/", "http://h.com:0/x", "http://h.com:007/x",
    "http://h_x.com/a b/c", "http://h.com/index.html", "http://h.com/a/default.htm?x=1", "http://h.com/Index.html",
    "http://h.com/a;p=1/b;q=2", "http://h.com/a;p=1/b", "http://h.com/x;a;b",
    "http://h.com/?z=1&a=2&z=3&e&&f=%zz&UTM_Source=x&ref=1&g=a+b*~%C3%A9&h=1=2",
    "http://h.com/?=v&k=", "http://h.com/?%75tm_source=1&b=%20", "http://[::1]:8080/x", "mailto:a@b.c", "/only/path", "",
    "  http://pad.com/x", "http://h.com/a\nb", "http://h.com?q=1", "//host/only", "http:///nohost", "http://h.com//double",
    "http://h.com/catalogue/index.html/", "ftp://h.com/f", "foo:bar", "1abc:foo", "http://h.com/é?ü=ß",
]
BAD = {"http://h.com:99999/": "bad_port", "http://h.com:ab/": "bad_port", "http://h.com:1:2/": "bad_port",
       "http://[::1/": "bad_host"}


def expected(url, sort_query=False):
    parts = urlparse(url)
    host = (parts.hostname or "").lower()
    port = parts.port
    if port in (0, {"http": 80, "https": 443}.get(parts.scheme)):
        port = None
    path = parts.path or "/"
    for name in ("index.html", "index.htm", "default.html", "default.htm"):
        if path.endswith("/" + name):
            path = path.removesuffix(name)
            break
    query = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items()
             if k.lower() not in urls.TRACKING_KEYS}
    if sort_query:
        query = dict(sorted(query.items()))
    return urlunparse((parts.scheme, f"{host}:{port}" if port else host, path, "", urlencode(query, doseq=True), ""))


@pytest.mark.parametrize("sort_query", [False, True])
def test_normalize_matches_standard_library(spark, sort_query):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows = df.select("url", urls.normalize_url(F.col("url"), sort_query).alias("n"),
                     urls.url_domain(F.col("url")).alias("d"), urls.url_path(F.col("url")).alias("p")).collect()
    for r in rows:
        assert r.n == expected(r.url, sort_query), r.url
        assert r.d == (urlparse(r.url).hostname or "").lower()
        assert r.p == urlparse(r.url).path


def test_bad_urls_give_a_reason_instead_of_an_error(spark):
    df = spark.createDataFrame([(u,) for u in BAD], "url string")
    for r in df.select("url", urls.normalize_url(F.col("url")).alias("n"), urls.url_error(F.col("url")).alias("e")).collect():
        assert r.n is None and r.e == BAD[r.url]


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([(u,) for u in URLS if u.startswith("http://h.com")], "url string")
    once = urls.normalize_url(F.col("url"))
    assert df.select((urls.normalize_url(once) == once).alias("same")).where("not same").count() == 0


def test_document_id(spark):
    url = "https://docs.com/page"
    got = spark.createDataFrame([(url,)], "url string").select(urls.document_id(F.col("url"))).first()[0]
    assert got == hashlib.sha256(url.encode()).hexdigest()[:16] == "aab6db068d1580d8"


def test_resolve_matches_standard_library(spark):
    bases = ["http://h.com/a/b/c?q=1#f", "http://h.com", "http://h.com/", "http://h.com/a/", "http://h.com/a//b;p", "", "http://h.com/a"]
    refs = ["", "x", "./x", "../x", "../../../x", "/x/../y", "/x/./y/..", "//o.com/p/../q", "?z=2", "#frag", ";par", "x;par?y#z",
            "http://o.com/a/../b", "https://o.com", "http:rel", "mailto:m@x", "x//y", "a/./b/../c/", "..", ".", "/", "javascript:void(0)",
            " /lead", "/a b", "x/", "g;x=1/../y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string")
    for r in df.select("base", "ref", urls.resolve_url(F.col("base"), F.col("ref")).alias("u")).collect():
        assert r.u == urljoin(r.base, r.ref), (r.base, r.ref)
