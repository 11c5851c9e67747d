"""Tables that the catalogued queries run on, derived from the given ones.

The given pages are alike (one article each, links only in their navigation), so
the queries add rewritten copies of every page that reach the other rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.urls import document_id, normalize_url
from pagemill.operators.enrich import content_type, text_to_html_ratio
from pagemill.schema import DOCUMENT_SCHEMA

FETCHED_AT = "2026-06-01T12:00:00Z"

# Rewrites of a page, applied in order; the first entry leaves it as it is.
PAGE_VARIANTS: tuple[tuple[tuple[str, str], ...], ...] = (
    (),
    (
        ("<article>", '<div class="post content">'),
        ("</article>", "</div>"),
        # Links that lead nowhere, to the page, away and up, before each of its own.
        ("<nav>", "<section>"),
        ("</nav>", "</section>"),
        (
            '<a href="/',
            '<a href="mailto:a@b.example">m</a><a href="#t">t</a><a href="JavaScript:x()">j</a><a href="">e</a>'
            '<a href="https://other.example.org/z">o</a><a href="../up?q=1&amp;ref=n#f">u</a><a href="/',
        ),
    ),
    (
        ("</article>", "</article></section>"),
        ("<article>", "<section><article><p>Lead in</article><article>"),
        ("<title>", "<!--"),  # the first heading is the title
        ("</title>", "-->"),
    ),
    (("<article>", ""), ("</article>", ""), ('<div class="ad">', '<div class="ad Social-Box"><div>inner</div>')),
    (
        ("<nav>", "<section>"),
        ("</nav>", "</section>"),
        (
            '<meta charset="utf-8">',
            '<meta charset="utf-8"><meta name="description" content=" About &amp; more "><meta name="keywords" content="">'
            '<meta name="author" content="A"><meta name="author" content="B"><meta property="og:title" content="O">',
        ),
        ("<article>", '<main role="main">'),
        ("</article>", "</main>"),
    ),
    (
        ("<title>", "<title>Site Name | "),
        ("<article>", '<div id="main"><ul><li class="menu-item">skip<li>keep'),
        ("</article>", "</ul></div>"),
    ),
    # Boilerplate all over: nothing is left.
    (("<body>", '<body class="has-menu">'), ("<title>", "<!--"), ("</title>", "-->")),
)

# Tails put on a page's address, each for one rule of the canonical form.
URL_TAILS = (
    "/index.html;v=1?z=1&a=2&z=3&e&&f=%zz&UTM_Source=x&g=a+b*~%C3%A9&h=1=2#frag",
    "/Default.htm?REF=1",
    "/a;p=1/default.htm",
    "?utm_medium=1&b=%20c",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; dealt into ``pagemill.catalog.spread`` partitions where the session sets that.

    Meant for small files of one row group each, which a scan cannot split.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("pagemill.catalog.spread", None)
    return df.repartition(int(spread)) if spread else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("fetched_at", F.to_timestamp(F.lit(FETCHED_AT)))


def _rewritten(html: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for old, new in steps:
        html = F.replace(html, F.lit(old), F.lit(new))
    return html


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in all variants; ``page_id`` is 10 times the old one plus the variant."""
    copies = F.array(*[_rewritten(F.col("html"), steps) for steps in PAGE_VARIANTS])
    return pages(spark, sf_dir).select("page_id", "url", "fetched_at", F.posexplode(copies).alias("variant", "html")).select(
        (F.col("page_id") * 10 + F.col("variant")).alias("page_id"), "url", "html", "fetched_at"
    )


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses and altered forms of them, as ``(page_id, form, url)``."""
    url = F.col("url")
    bare = F.regexp_replace(url, "[?#].*$", "")
    site = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    rest = F.substr(url, F.length(site) + 1)
    host = F.regexp_replace(site, "^https?://", "")
    forms = F.array(
        url,
        F.concat(F.lit("HTTPS://User:pw@"), F.upper(host), F.lit(":443"), rest),
        F.concat(F.lit("http://"), host, F.lit(":0443"), rest),
        F.concat(site, F.lit(":99999"), rest),
        site,
        *[F.concat(bare, F.lit(tail)) for tail in URL_TAILS],
    )
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


# References tried on every page; {w} is the first word of its path.
REFERENCES = (
    "../x", "./{w}/./y", "?q={w}", "//other.example.com/{w}/../z", "/abs/../{w}", "#top", "", "mailto:a@b",
    "{w}//d;p=1?q#f", "../../../{w}", "https://Else.example.com/a/../b", "..", ".", "{w}/",
)


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    refs = F.array(*[F.replace(F.lit(ref), F.lit("{w}"), word) for ref in REFERENCES])
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(refs).alias("ref_no", "ref"))


# Path and link count per class of word counts, so that all page types occur.
WORD_CLASSES = (
    (20, "/faq/", 0), (40, "/list", 12), (60, "/people/", 0), (80, "/shop/", 1), (120, "/catalogue/a/b/", 0),
    (160, "/posts/", 11), (220, "/kb/", 0), (400, "/posts/", 0),
)
_LAST_CLASS = ("/posts/docs/", 30)


def by_word_class(words: Column, place: int) -> Column:
    chain = F.when(words < WORD_CLASSES[0][0], WORD_CLASSES[0][place])
    for entry in WORD_CLASSES[1:]:
        chain = chain.when(words < entry[0], entry[place])
    return chain.otherwise(_LAST_CLASS[place - 1])


def collection(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The documents table, as it is or as dealt by the caller, in the document schema, plus ``row_id`` for its row."""
    body, words = F.col("text"), F.col("word_count")
    base = (table(spark, sf_dir, "documents") if docs is None else docs).select(
        F.col("doc_id").alias("row_id"), "text", "lang", "source",
        text.word_count(body).alias("word_count"), text.char_count(body).alias("char_count"),
    )
    path = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"), by_word_class(words, 1), F.substr(F.sha2(body, 256), F.lit(1), F.lit(12)))
    html_length = F.col("char_count") * 2 + F.when(words < 60, 4000).otherwise(100)
    links = by_word_class(words, 2)
    linked = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(100)), F.lit(1), links), lambda i: F.concat(F.lit("https://x.com/"), i.cast("string"))
    )
    return (
        base.withColumn("url", normalize_url(path))
        .withColumns(
            {
                "doc_id": document_id(F.col("url")),
                "title": F.regexp_extract("text", r"^([^\n]*)", 1),
                "body_text": body,
                "fetched_at": F.when(words < 100, F.lit("2026-05-31T00:00:00Z")).otherwise(F.lit(FETCHED_AT)),
                "language": F.when(words >= 20, F.col("lang")),
                "content_type": content_type(F.col("url"), body, words, links),
                "text_to_html_ratio": text_to_html_ratio(F.col("char_count"), html_length),
                "links_out_internal": linked,
            }
        )
        .select("row_id", *DOCUMENT_SCHEMA.names)
    )


def visited_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole collection, where every third row has the address of page ``row_id`` of the site of ``fetch_log``."""
    i = F.col("row_id")
    page = F.concat(F.lit("https://site.example.com/p/"), i.cast("string"), F.when(i % 4 == 1, "/").otherwise(""))
    rows = collection(spark, sf_dir).withColumns(
        {"url": F.when(i % 3 == 0, page).otherwise(F.col("url")), "source": F.when(i % 3 == 0, "site.example.com").otherwise(F.col("source"))}
    )
    return rows.withColumn("doc_id", document_id(F.col("url"))).drop("row_id")


def link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes and links of a made-up site over the given pages.

    Page ``i`` links to pages ``2i+1`` and ``2i+2`` and back to page 0; pages with
    a campaign tag cannot be fetched and pages with an anchor have no text.
    """
    ids = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url"), F.col("url").alias("raw"))
    # Addresses that become equal are one page: the lowest id stands for it.
    nodes = ids.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("raw", "page_id").alias("raw"))
    outcomes = nodes.where(~F.contains("raw", F.lit("utm_source")) | (F.col("page_id") == 0)).select(
        "url", F.when(F.contains("raw", F.lit("#top")) & (F.col("page_id") > 0), "empty").otherwise("saved").alias("outcome")
    )
    targets = F.array(F.col("page_id") * 0, F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)
    edges = nodes.select("url", F.posexplode(targets).alias("rank", "target"))
    links = edges.join(ids.select(F.col("page_id").alias("target"), F.col("url").alias("link")), "target")
    return outcomes, links.select("url", "rank", "link")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts of one made-up site over the given pages.

    Page ``i`` is ``/p/<i>`` and links to ``/p/<2i+1>`` and ``/p/<2i+2>``. Some pages are
    missing or time out, every third one was also fetched a day before under another
    title, every fifth one failed a day later, and every fourth one redirects.
    """
    i = F.col("page_id")
    anchors = F.concat(
        F.lit('<article><a href="/p/'), (i * 2 + 1).cast("string"), F.lit('">one</a> <a href="/p/'), (i * 2 + 2).cast("string"),
        F.lit('?utm_source=x#top">two</a> <a href="/p/1.pdf">no</a> <a href="mailto:a@b.example">no</a>'),
    )
    status = F.when((i > 0) & (i % 7 == 6), 404).when((i > 0) & (i % 13 == 12), F.lit(None).cast("int")).otherwise(200)
    day = F.expr("INTERVAL 1 DAY")
    moment = F.to_timestamp(F.lit(FETCHED_AT))

    def attempt(number: int, at: Column, code: Column, html: Column) -> Column:
        return F.struct(F.lit(number).alias("number"), at.alias("fetched_at"), code.cast("int").alias("status_code"), html.alias("html"))

    attempts = F.array_compact(
        F.array(
            attempt(0, moment, status, F.col("html")),
            F.when(i % 3 == 0, attempt(1, moment - day, F.lit(200), F.replace("html", F.lit("<title>"), F.lit("<title>Old ")))),
            F.when(i % 5 == 0, attempt(2, moment + day, F.lit(500), F.lit(None).cast("string"))),
        )
    )
    address = F.concat(F.lit("https://site.example.com/p/"), i.cast("string"))
    rows = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<article>"), anchors))
    return rows.select("page_id", F.inline(attempts)).select(
        (i * 10 + F.col("number")).alias("page_id"),
        address.alias("url"),
        F.when(i % 4 == 1, F.concat(address, F.lit("/index.html"))).otherwise(address).alias("final_url"),
        "status_code",
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        "html",
        F.when(F.col("status_code").isNull(), "request timed out").alias("error"),
        "fetched_at",
    )
