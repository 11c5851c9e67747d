"""Block-wise extraction that favours precision over recall.

Text is split into blocks at block-level tags; a block is kept when it has
enough words and few of them are link text (shallow text features after
Kohlschuetter et al. 2010). Comments and boilerplate elements are dropped,
tables are kept. It does not reproduce any particular extraction library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markup, text
from pagemill.functions.entities import decode_entities
from pagemill.operators import extract
from pagemill.operators.extract import copartitioned, field_record, kept_tokens, meta_map, page_layout

META_TAGS = {
    "author": (("name", "author"), ("property", "article:author")),
    "description": (("name", "description"), ("property", "og:description")),
    "categories": (("name", "category"), ("property", "article:section")),
    "tags": (("name", "keywords"), ("property", "article:tag")),
}

_BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "footer",
               "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "html", "li", "main", "nav", "ol",
               "p", "pre", "section", "table", "td", "th", "title", "tr", "ul")


# What a kept token does to the blocks.
_TEXT, _BLOCK, _TITLE_ON, _TITLE_OFF, _LINK_ON, _LINK_OFF, _NOTHING = range(7)
_BLOCK_TYPE = "struct<from:int,to:int,words:bigint,link_words:bigint,texts:int,titled:boolean>"
_STATE_TYPE = f"struct<done:array<{_BLOCK_TYPE}>,from:int,words:bigint,link_words:bigint,texts:int,link:int,title:int>"


def coded_tokens(kept: Column) -> Column:
    """Array of ``(code, words, txt)`` for the kept tokens; decoded text and its words for text runs."""

    def tag(token: Column) -> Column:
        def code(name: Column) -> Column:
            off = markup.is_closer(token)
            return (
                F.when(name == "title", F.when(off, _TITLE_OFF).otherwise(_TITLE_ON))
                .when(name.isin(*_BLOCK_TAGS), _BLOCK)
                .when(name == "a", F.when(off, _LINK_OFF).otherwise(_LINK_ON))
                .otherwise(_NOTHING)
            )

        return F.when(markup.is_tag(token), text.bind(markup.tag_name(token), code)).otherwise(_NOTHING)

    def coded(token: Column) -> Column:
        found = text.bind(decode_entities(token), lambda txt: F.struct(F.lit(_TEXT).alias("code"), text.word_count(txt).alias("words"), txt.alias("txt")))
        return F.when(~markup.is_markup(token), found).otherwise(
            F.struct(tag(token).alias("code"), F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("string").alias("txt"))
        )

    return F.transform(kept, lambda t: coded(t["txt"]))


def text_blocks(coded: Column) -> Column:
    """Array of the blocks that hold text runs: their range of tokens, words, link words and whether they are titles.

    One pass over the tokens, which keeps numbers only; a block is added where it ends.
    """

    def ended(state: Column, i: Column) -> Column:
        block = F.struct(
            state["from"].alias("from"), i.cast("int").alias("to"), state["words"].alias("words"), state["link_words"].alias("link_words"),
            state["texts"].alias("texts"), (state["title"] > 0).alias("titled"),
        )
        return F.when(state["texts"] > 0, F.concat(state["done"], F.array(block.cast(_BLOCK_TYPE)))).otherwise(state["done"])

    def step(state: Column, t: Column) -> Column:
        code, words, i = t["code"], t["words"], t["i"]
        cut = code.isin(_BLOCK, _TITLE_ON, _TITLE_OFF)
        is_text = code == _TEXT
        zero = F.lit(0).cast("bigint")
        return F.struct(
            F.when(cut, ended(state, i)).otherwise(state["done"]).alias("done"),
            F.when(cut, i + 1).otherwise(state["from"]).cast("int").alias("from"),
            F.when(cut, zero).otherwise(state["words"] + words).alias("words"),
            F.when(cut, zero).otherwise(state["link_words"] + F.when(state["link"] > 0, words).otherwise(zero)).alias("link_words"),
            F.when(cut, 0).otherwise(state["texts"] + is_text.cast("int")).alias("texts"),
            (state["link"] + F.when(code == _LINK_ON, 1).when(code == _LINK_OFF, -1).otherwise(0)).alias("link"),
            (state["title"] + F.when(code == _TITLE_ON, 1).when(code == _TITLE_OFF, -1).otherwise(0)).alias("title"),
        ).cast(_STATE_TYPE)

    numbered = F.transform(coded, lambda t, i: F.struct(t["code"].alias("code"), t["words"].alias("words"), i.alias("i")))
    start = F.struct(F.array().alias("done"), *[F.lit(0).alias(n) for n in ("from", "words", "link_words", "texts", "link", "title")]).cast(_STATE_TYPE)
    return F.aggregate(numbered, start, step, lambda state: ended(state, F.size(coded)))


def precise_record(kept: Column, meta: Column, min_words: int = 10, max_link_density: float = 0.33) -> Column:
    """The fields of a page from its kept tokens, as an array of one struct; null if no block is kept."""

    def cut(coded: Column, blocks: Column) -> Column:
        def line(b: Column) -> Column:
            runs = F.filter(F.slice(coded, b["from"] + 1, b["to"] - b["from"]), lambda t: t["code"] == _TEXT)
            return text.one_line(F.array_join(F.transform(runs, lambda t: t["txt"]), " "))

        good = F.filter(
            blocks, lambda b: ~b["titled"] & (b["words"] >= min_words) & (b["link_words"] <= b["words"] * F.lit(max_link_density))
        )
        title = F.try_element_at(F.transform(F.slice(F.filter(blocks, lambda b: b["titled"]), 1, 1), line), F.lit(1))
        return text.bind(
            F.array_join(F.transform(good, line), "\n"),
            lambda body: F.when(
                body != "",
                F.array(
                    F.struct(
                        F.coalesce(title, F.lit("")).alias("title"), body.alias("body_text"),
                        F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("meta"), F.length("html").cast("bigint").alias("html_length"),
                    )
                ),
            ),
        )

    return text.bind(coded_tokens(kept), lambda coded: text.bind(text_blocks(coded), lambda blocks: cut(coded, blocks)))


def extract_precise(
    pages: DataFrame, key: str = "page_id", min_words: int = 10, max_link_density: float = 0.33
) -> DataFrame:
    """Title, main text, metadata and HTML length per page with any kept block."""
    spread = copartitioned(pages, key, (key, "html"))
    layout = page_layout(spread, key, META_TAGS).hint("shuffle_hash")
    record = text.bind(
        kept_tokens(markup.tokens(F.col("html")), F.col("cuts")), lambda kept: precise_record(kept, meta_map(META_TAGS), min_words, max_link_density)
    )
    found = spread.join(layout, key, "left").select(key, F.inline_outer(record))
    return found.where(F.col("body_text").isNotNull())


def extract_both(pages: DataFrame, key: str = "page_id", min_words: int = 10, max_link_density: float = 0.33) -> DataFrame:
    """``(key, extractor, title, body_text, meta, html_length)`` by the extractors ``heuristic`` and ``precision``.

    One exchange of the pages, one structure and one split into tokens serve both.
    """
    spread = copartitioned(pages, key, (key, "html"))
    tags = {f"h_{name}": found for name, found in extract.META_TAGS.items()} | {f"p_{name}": found for name, found in META_TAGS.items()}
    layout = page_layout(spread, key, tags).hint("shuffle_hash")

    def named(name: str, records: Column) -> Column:
        return F.transform(records, lambda r: F.struct(F.lit(name).alias("extractor"), *[r[c].alias(c) for c in ("title", "body_text", "meta", "html_length")]))

    def records(page_tokens: Column, kept: Column) -> Column:
        runs = F.filter(kept, lambda t: ~markup.is_markup(t["txt"]))
        one = text.bind(runs, lambda r: field_record(page_tokens, r, meta_map(extract.META_TAGS, "h_")))
        two = precise_record(kept, meta_map(META_TAGS, "p_"), min_words, max_link_density)
        return F.flatten(F.array_compact(F.array(named("heuristic", one), named("precision", two))))

    both = text.bind(
        markup.tokens(F.col("html")), lambda toks: text.bind(kept_tokens(toks, F.col("cuts")), lambda kept: records(toks, kept))
    )
    return spread.join(layout, key, "left").select(key, F.inline_outer(both)).where(F.col("extractor").isNotNull())
