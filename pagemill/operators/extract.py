"""Title, main text, metadata and links of pages.

The structure windows (:mod:`pagemill.operators.elements`) leave one small row
per page: the spans that boilerplate removes, the candidate containers and the
positions of title, heading, anchors and metadata. That row meets its page again
on the page key, where the text is cut out of the token array by slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.functions.entities import decode_entities
from pagemill.functions.memo import kept_columns
from pagemill.functions.urls import normalize_url, resolve_url, url_domain
from pagemill.operators.elements import elements, tag_rows

# Link schemes that lead to no page, title separators.
SKIPPED_LINKS = "^(?:mailto:|javascript:|tel:|#)"
TITLE_SEPARATORS = "[|–—:-]"

# Output name of a metadata entry and the tags that may hold it.
META_TAGS = {
    "description": (("name", "description"),),
    "keywords": (("name", "keywords"),),
    "author": (("name", "author"),),
    "og_title": (("property", "og:title"),),
}
MetaTags = dict[str, tuple[tuple[str, str], ...]]


def _span(*extra: Column) -> Column:
    return F.struct(F.col("start"), F.col("end"), *extra)


def copartitioned(pages: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The one exchange of the extraction: whole pages, hashed by their key.

    The key test is what a join on the key infers; stated here, both readers of
    the exchange share it.
    """
    return pages.select(*columns).where(F.col(key).isNotNull()).repartition(key)


def page_layout(
    pages: DataFrame, key: str = "page_id", meta_tags: MetaTags = META_TAGS, anchors: bool = False
) -> DataFrame:
    """One row per page that has any tag: spans needed to cut out its fields, and its ``anchors`` if wanted."""
    seen = ~F.col("hidden")

    def first_content(tags: tuple[tuple[str, str], ...]) -> Column:
        named = F.lit(False)
        for attr, value in tags:
            named = named | F.coalesce(F.col(f"meta.{attr}") == value, F.lit(False))
        return F.min(F.when(seen & named, F.struct("start", F.col("meta.content").alias("content"))))

    metas = [first_content(tags).alias(f"meta_{out}") for out, tags in meta_tags.items()]
    candidate = _span(F.col("parent"), F.col("parent_end"), F.col("selectors"))
    linked = seen & (F.col("tag") == "a") & F.col("href").isNotNull() & ~F.col("href").rlike(SKIPPED_LINKS)
    if anchors:
        metas.append(F.sort_array(F.collect_list(F.when(linked, F.struct("start", "href")))).alias("anchors"))
    return elements(pages, key, anchors=anchors).groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("cut_from").isNotNull(), F.struct(F.col("cut_from").alias("from"), F.col("end").alias("to"))))
        ).alias("cuts"),
        F.collect_list(F.when(seen & (F.size("selectors") > 0), candidate)).alias("candidates"),
        F.min(F.when(seen & (F.col("tag") == "title"), _span())).alias("title_span"),
        F.min(F.when(seen & (F.col("tag") == "h1"), _span())).alias("heading_span"),
        F.min(F.when(seen & (F.col("tag") == "body"), _span())).alias("body_span"),
        *metas,
    )


def kept_tokens(page_tokens: Column, cuts: Column) -> Column:
    """Array of ``(pos, txt)`` for the tokens outside the removed spans."""
    nothing = F.array().cast("array<struct<from:int,to:int>>")

    def sliced(gaps: Column) -> Column:
        return F.flatten(
            F.transform(
                gaps,
                lambda g: F.transform(
                    F.slice(page_tokens, g["from"] + 1, F.greatest(g["to"] - g["from"], F.lit(0))),
                    lambda t, i: F.struct((g["from"] + i).alias("pos"), t.alias("txt")),
                ),
            )
        )

    starts = F.concat(F.array(F.lit(0)), F.transform(F.coalesce(cuts, nothing), lambda c: c["to"] + 1))
    stops = F.concat(F.transform(F.coalesce(cuts, nothing), lambda c: c["from"]), F.array(F.size(page_tokens)))
    return text.bind(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("from"), b.alias("to"))), sliced)


def visible_text(page_tokens: Column, cuts: Column) -> Column:
    """Array of ``(pos, txt)`` for the text runs outside the removed spans."""
    return F.filter(kept_tokens(page_tokens, cuts), lambda t: ~markup.is_markup(t["txt"]))


def _texts(runs: Column, span: Column) -> Column:
    inside = F.filter(runs, lambda t: (t["pos"] >= span["start"]) & (t["pos"] <= span["end"]))
    return F.transform(inside, lambda t: t["txt"])


def _has_text(runs: Column, span: Column) -> Column:
    return F.exists(
        runs,
        lambda t: (t["pos"] >= span["start"]) & (t["pos"] <= span["end"]) & ~markup.is_blank(t["txt"]),
    )


def container_span(runs: Column, candidates: Column, body_span: Column) -> Column:
    """Span of the main content.

    Per selector, in order, only its first match counts and only if it holds
    text. When direct siblings match the same selector, their parent is taken.
    Without any match the body is used, or else the whole page.
    """

    def chosen(rank: Column) -> Column:
        matches = F.filter(candidates, lambda c: F.array_contains(c["selectors"], rank))
        return text.bind(
            F.struct(F.array_min(matches).alias("first"), matches.alias("all")),
            lambda m: F.when(_has_text(runs, m["first"]), promoted(m["first"], m["all"])),
        )

    def promoted(first: Column, matches: Column) -> Column:
        alike = F.size(F.filter(matches, lambda c: c["parent"] == first["parent"]))
        outer = F.struct(F.greatest(first["parent"], F.lit(0)).alias("start"), first["parent_end"].alias("end"))
        return F.when(alike > 1, outer).otherwise(F.struct(first["start"].alias("start"), first["end"].alias("end")))

    matched = F.array_sort(F.array_distinct(F.flatten(F.transform(candidates, lambda c: c["selectors"]))))
    whole = F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))
    found = F.try_element_at(F.array_compact(F.transform(matched, chosen)), F.lit(1))
    return F.coalesce(found, body_span, whole)


def _raw_title(page_tokens: Column, title_span: Column) -> Column:
    # A title with inner tags has no single text; an empty one does not count.
    return F.when(
        title_span["end"] - title_span["start"] == 2,
        F.element_at(page_tokens, title_span["start"] + 2),
    )


def _title(title: Column, heading_pieces: Column) -> Column:
    """First part of ``<title>``, else the first heading, else ``''``."""
    separator = f"[{text.SPACE}]*{TITLE_SEPARATORS}[{text.SPACE}]*"
    first = text.strip(F.element_at(F.split(text.strip(title), separator), 1))
    heading = F.array_join(F.transform(heading_pieces, text.strip), "")
    return F.coalesce(first, heading, F.lit(""))


def meta_map(meta_tags: MetaTags = META_TAGS, prefix: str = "") -> Column:
    """Map of the non-empty metadata of a layout row, whose columns may have a prefix before each name."""
    entries = F.array(
        *[
            F.when(
                F.col(f"meta_{prefix}{out}.content") != "",
                F.struct(F.lit(out).alias("key"), F.col(f"meta_{prefix}{out}.content").alias("value")),
            )
            for out in meta_tags
        ]
    )
    pairs = F.map_from_entries(F.array_compact(entries))
    return F.transform_values(pairs, lambda _, value: text.strip(decode_entities(value)))


def raw_references(page_tokens: Column) -> Column:
    """The non-empty references of all anchors of a page, in order; those to no page are left out."""
    anchors = F.filter(page_tokens, lambda t: t.rlike(r"^<[aA][\s/]"))
    found = F.transform(anchors, lambda t: markup.attribute(t, "href"))
    return F.filter(found, lambda href: (href != "") & ~href.rlike(SKIPPED_LINKS))


def field_record(page_tokens: Column, runs: Column, meta: Column, *extra: Column) -> Column:
    """The fields of a page cut out of its tokens by its layout row, as an array of one struct; null without text."""
    no_spans = F.array().cast("array<struct<start:int,end:int,parent:int,parent_end:int,selectors:array<int>>>")

    def record(body: Column, texts: Column) -> Column:
        row = F.struct(
            _title(texts[1], F.split(texts[2], "\x00")).alias("title"),
            body.alias("body_text"),
            meta.alias("meta"),
            F.length("html").cast("bigint").alias("html_length"),
            *extra,
        )
        return F.when(body != "", F.array(row))

    span = container_span(runs, F.coalesce("candidates", no_spans), F.col("body_span"))
    raw = F.array(
        text.bind(span, lambda s: F.array_join(_texts(runs, s), "\n")),
        _raw_title(page_tokens, F.col("title_span")),
        # NUL cannot occur in HTML text, so it can part the pieces.
        F.array_join(_texts(runs, F.col("heading_span")), "\x00"),
    )
    return text.bind(
        F.transform(raw, decode_entities),
        lambda texts: text.bind(text.tidy_lines(texts[0]), lambda body: record(body, texts)),
    )


@kept_columns
def _page_fields(links: str | None) -> Column:
    """The fields of a page that has met its layout row, as an array of one struct; null without text."""

    def extra(page_tokens: Column) -> list[Column]:
        return [raw_references(page_tokens).alias("references")] if links == "raw" else []

    # Each stage is bound once. The closing generator keeps the emptiness test from
    # being pushed down, its outer form from being inferred: either way all stages
    # would be evaluated again.
    return text.bind(
        markup.tokens(F.col("html")),
        lambda toks: text.bind(visible_text(toks, F.col("cuts")), lambda runs: field_record(toks, runs, meta_map(), *extra(toks))),
    )


@kept_columns
def _internal_links(seed_domain: str | None) -> Column:
    """The distinct links inside the site among a page's ``references``."""
    home = F.lit(seed_domain) if seed_domain is not None else url_domain(F.col("url"))
    resolved = F.transform(
        F.coalesce("references", F.array().cast("array<string>")),
        lambda href: normalize_url(resolve_url(F.col("url"), decode_entities(href))),
    )
    return F.array_distinct(text.bind(home, lambda h: F.filter(F.array_compact(resolved), lambda link: url_domain(link) == h)))


@kept_columns
def _internal_link(seed_domain: str | None) -> Column:
    """The link of an anchor's ``href`` as an array of one; null inside for one that leads nowhere or off the site."""
    home = F.lit(seed_domain) if seed_domain is not None else url_domain(F.col("url"))
    link = normalize_url(resolve_url(F.col("url"), decode_entities(F.col("href"))))
    return F.array(text.bind(link, lambda found: F.when(url_domain(found) == home, found)))


def extract_fields(
    pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = (), links: str | None = None, seed_domain: str | None = None
) -> DataFrame:
    """Title, main text, metadata and HTML length per page that has any text.

    ``keep`` passes page columns on; they meet the result by key and do not travel
    with the page, whose exchange both of its readers share. With ``links`` (a scope of
    :func:`page_links`) there are also the page's internal links: cleaned ones come from the
    same structure, raw ones from the same tokens, both without a further exchange of
    pages; ``keep`` must then have ``url``.
    """
    if links not in (None, "cleaned", "raw"):
        raise ValueError(f"unknown link scope {links!r}; use 'cleaned' or 'raw'")
    spread = copartitioned(pages, key, (key, "html"))
    layout = page_layout(spread, key, anchors=links == "cleaned").hint("shuffle_hash")
    joined = spread.join(layout, key, "left")

    cleaned = [F.transform("anchors", lambda a: a["href"]).alias("references")] if links == "cleaned" else []
    found = joined.select(key, *cleaned, F.inline_outer(_page_fields(links))).where(F.col("body_text").isNotNull())
    if keep:
        found = found.join(pages.select(key, *keep).hint("shuffle_hash"), key)
    if not links:
        return found
    return found.withColumn("links_internal", _internal_links(seed_domain)).drop("references")


def page_links(
    pages: DataFrame,
    key: str = "page_id",
    scope: str = "cleaned",
    seed_domain: str | None = None,
) -> DataFrame:
    """Distinct internal links of each page, as rows ``(key, rank, link)``.

    ``scope='cleaned'`` reads anchors left after boilerplate removal and keeps
    empty references; ``'raw'`` reads all anchors and skips empty ones. Links
    stay when their host equals the seed domain, or the page's own host when no
    seed is given. ``rank`` orders links by first appearance.
    """
    if scope not in ("cleaned", "raw"):
        raise ValueError(f"unknown link scope {scope!r}; use 'cleaned' or 'raw'")
    if scope == "cleaned":
        spread = copartitioned(pages, key, (key, "url", "html"))
        anchors = elements(spread, key, ("url",)).where(~F.col("hidden"))
    else:
        # No structure is needed, so pages stay where they are; only links are exchanged.
        anchors = tag_rows(pages, key, ("url",)).where(~F.col("closer")).withColumnRenamed("pos", "start")
        anchors = anchors.where(F.col("href") != "")
    anchors = anchors.where((F.col("tag") == "a") & F.col("href").isNotNull() & ~F.col("href").rlike(SKIPPED_LINKS))
    # The outer generator keeps the test of a link apart from its making, which would be done again for every use.
    found = anchors.select(key, F.col("start").alias("rank"), F.explode_outer(_internal_link(seed_domain)).alias("link"))
    return found.where(F.col("link").isNotNull()).groupBy(key, "link").agg(F.min("rank").alias("rank")).select(key, "rank", "link")


def link_lists(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Links of a page as one array, in order of first appearance."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "link")))
    return links.groupBy(key).agg(F.transform(ordered, lambda x: x["link"]).alias("links_internal"))
