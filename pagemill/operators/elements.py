"""Element structure of pages: tag tokens paired into spans by window functions.

One row per tag goes through the windows; text never does. Every window and
aggregate is keyed by the page (or the page and more), so a single exchange on
the page key serves them all; a table bucketed by that key needs none.

Nesting is tracked per tag name, so an unclosed ``<b>`` or a stray ``</div>``
disturbs nothing else. A tag left open runs to the end of its parent. Tags whose
end tag HTML lets authors omit end at the next tag of their family in the same
parent. Elements that overlap without nesting are not rearranged the way a
repairing parser would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import markup
from pagemill.functions.memo import kept_columns
from pagemill.functions.text import SPACE, bind

# Elements that are never main content.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "noscript")
# Class or id fragments that mark boilerplate.
NOISE_PATTERN = "(?i)sidebar|menu|nav|footer|header|cookie|popup|modal|advertisement|social|widget|banner"
# Elements whose text a reader of the page does not see as running text.
UNREAD_TAGS = ("template", "rt", "rp")

# Main-content selectors, best first.
CONTENT_NAMES = ("content", "main", "body", "article", "post")

# Tags read in any case, and what any other tag must hold to be boilerplate or main content.
_ALWAYS_READ = (*NOISE_TAGS, *UNREAD_TAGS, "main", "article", "div", "title", "h1", "body", "meta")
_HINT = f"{NOISE_PATTERN}|role"

# End tags that may be omitted, and the family whose next tag ends the element.
_FAMILY = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "td": "td", "th": "td", "tr": "tr", "option": "option"}
# Block elements end an open paragraph.
_BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "dt", "dd", "fieldset", "footer",
           "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol",
           "pre", "section", "table", "td", "th", "tr", "ul")


def _selectors(tag: Column, css_class: Column, css_id: Column, role: Column) -> Column:
    """Ranks of the content selectors that an element matches, best first."""
    classes = F.split(css_class, f"[{SPACE}]+")
    tests = [tag == "main", tag == "article", role == "main"]
    tests += [(tag == "div") & F.array_contains(classes, name) for name in CONTENT_NAMES]
    tests += [(tag == "div") & (css_id == name) for name in CONTENT_NAMES]
    ranks = F.array(*[F.when(test, F.lit(rank)) for rank, test in enumerate(tests)])
    return F.array_compact(ranks)


def tag_rows(pages: DataFrame, key: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per tag token: position, name, role in the structure, attributes.

    ``carry`` names page columns to keep on anchor rows (for link resolution).
    """
    split = pages.withColumn("_tokens", markup.tokens(F.col("html")))
    # The outer form keeps the optimizer from testing for empty arrays first, which
    # would split every page once more.
    exploded = split.select(
        key, *carry, F.size("_tokens").alias("page_tokens"), F.posexplode_outer("_tokens").alias("pos", "token")
    ).where(markup.is_tag(F.col("token")))
    read = exploded.select(key, *carry, "page_tokens", "pos", *_token_columns())
    carried = [F.when(F.col("tag") == "a", F.col(name)).alias(name) for name in carry]
    return read.select(key, *carried, "page_tokens", "pos", *_role_columns())


@kept_columns
def _token_columns() -> list[Column]:
    return _read_out(F.col("token"))


@kept_columns
def _role_columns() -> list[Column]:
    return _roles(F.col)


def _read_out(token: Column) -> list[Column]:
    """What is read from a tag token."""
    return _read_named(token, markup.raw_name(token))


def _read_named(token: Column, name: Column) -> list[Column]:
    # Only what is longer than its name in brackets can have attributes; most tags are not.
    read = ~markup.is_closer(token) & (F.length(token) > F.length(name) + 2)
    return [
        F.lower(name).alias("tag"),
        markup.is_closer(token).alias("closer"),
        markup.is_self_closed(token).alias("self_closed"),
        *[F.when(read, markup.attribute(token, attr)).alias(out) for attr, out in (("class", "css_class"), ("id", "css_id"), ("role", "role"))],
        F.when(read & token.rlike(r"^<[aA][\s/]"), markup.attribute(token, "href")).alias("href"),
        F.when(
            read & token.rlike(r"(?i)^<meta\b"),
            F.struct(*[markup.attribute(token, attr).alias(attr) for attr in ("name", "property", "content")]),
        ).alias("meta"),
    ]


def _roles(read: Callable[[str], Column]) -> list[Column]:
    """The part that a tag plays in the structure, from what was read of it."""
    tag, closer, css_class, css_id, role = map(read, ("tag", "closer", "css_class", "css_id", "role"))
    opener = ~closer
    void = tag.isin(*markup.VOID_TAGS) | read("self_closed")
    family = F.create_map(*[F.lit(part) for pair in _FAMILY.items() for part in pair])
    marked = F.coalesce(css_class.rlike(NOISE_PATTERN), F.lit(False)) | F.coalesce(css_id.rlike(NOISE_PATTERN), F.lit(False))
    noise = opener & (tag.isin(*NOISE_TAGS) | marked)
    plain = F.coalesce(css_class, css_id, role).isNull() & ~tag.isin("main", "article")
    return [
        tag.alias("tag"),
        closer.alias("closer"),
        F.when(closer & tag.isin(*markup.VOID_TAGS), F.lit("ignored"))
        .when(void & opener, F.lit("void"))
        .when(tag.isin(*_FAMILY), F.lit("implied"))
        .otherwise(F.lit("paired")).alias("kind"),
        F.element_at(family, tag).alias("family"),
        noise.alias("noise"),
        (noise | (opener & tag.isin(*UNREAD_TAGS))).alias("unread"),
        F.when(plain | closer, F.array().cast("array<int>"))
        .otherwise(_selectors(tag, F.coalesce(css_class, F.lit("")), F.coalesce(css_id, F.lit("")), F.coalesce(role, F.lit(""))))
        .alias("selectors"),
        read("href").alias("href"),
        read("meta").alias("meta"),
    ]


@kept_columns
def _structure_tags(anchors: bool) -> Column:
    """A page's tags that bear on what its elements are read for, as an array; those that change nothing else are left out.

    Wanted are elements with a role of their own. Void tags and tags with an omissible end only matter
    besides these where one of them ends a wanted element of its family. Links count as wanted with ``anchors``. A pair with nothing of this in
    between has its end at hand: it becomes one ``leaf`` entry, or goes if it is not wanted.
    """

    def entry(page_tokens: Column, t: Column) -> Column:
        token = F.get(page_tokens, t["pos"])
        read_out = bind(markup.raw_name(token), lambda name: F.struct(*_read_named(token, name)))
        return bind(read_out, lambda read: bind(F.struct(*_roles(lambda name: read[name])), lambda role: placed(t["pos"], role)))

    def placed(pos: Column, role: Column) -> Column:
        wanted = ~role["closer"] & (
            role["unread"] | (F.size(role["selectors"]) > 0) | role["meta"].isNotNull() | role["tag"].isin("title", "h1", "body")
            | (role["href"].isNotNull() if anchors else F.lit(False))
        )
        names = ("tag", "closer", "kind", "family", "noise", "unread", "selectors", "href", "meta")
        return F.struct(pos.alias("pos"), *[role[name].alias(name) for name in names], wanted.alias("wanted"), F.lit(None).cast("int").alias("leaf_end"))

    def ends_some(t: Column, families: Column) -> Column:
        own = F.coalesce(F.array_contains(families, t["family"]), F.lit(False))
        return own | (F.array_contains(families, "p") & t["tag"].isin(*_BLOCKS))

    def lasting(tags: Column) -> Column:
        implied = F.filter(tags, lambda t: t["wanted"] & (t["kind"] == "implied"))
        return bind(F.array_distinct(F.transform(implied, lambda t: t["family"])), lambda families: reduced(tags, families))

    def reduced(tags: Column, families: Column) -> Column:
        def kept(t: Column) -> Column:
            # An end tag may belong to a start tag of its name that closes itself.
            pairing = (t["kind"] == "paired") | ((t["kind"] == "void") & ~t["tag"].isin(*markup.VOID_TAGS))
            return pairing | t["wanted"] | ((t["kind"] != "ignored") & ends_some(t, families))

        def joined(some: Column) -> Column:
            def is_leaf(t: Column, end: Column) -> Column:
                matched = (t["kind"] == "paired") & ~t["closer"] & (end["kind"] == "paired") & end["closer"] & (end["tag"] == t["tag"])
                return F.coalesce(matched & (F.size(t["selectors"]) == 0), F.lit(False))

            def at(t: Column, i: Column) -> Column:
                leaf = t.withField("kind", F.lit("leaf")).withField("leaf_end", F.get(some, i + 1)["pos"])
                stays = t["wanted"] | ends_some(t, families)
                return (
                    F.when(is_leaf(t, F.get(some, i + 1)), F.when(stays, leaf))
                    .when(t["closer"] & F.coalesce(is_leaf(F.get(some, i - 1), t), F.lit(False)), F.lit(None))
                    .otherwise(t)
                )

            return F.filter(F.transform(some, at), lambda t: t.isNotNull())

        found = F.filter(tags, kept)
        for _ in range(2):  # what held only dropped pairs is a pair with nothing in between, too
            found = bind(found, joined)
        return found

    def named(token: Column, pos: Column) -> Column:
        def looked_at(name: Column) -> Column:
            opener, long = ~markup.is_closer(token), F.length(token) > F.length(name) + 2
            link = token.rlike(r"^<[aA][\s/]") if anchors else F.lit(False)
            maybe = opener & (F.lower(name).isin(*_ALWAYS_READ) | (long & (link | token.rlike(_HINT))))
            return F.struct(pos.alias("pos"), F.lower(name).alias("tag"), (~opener).alias("closer"), maybe.alias("maybe"))

        return bind(markup.raw_name(token), looked_at)

    def read_on(page_tokens: Column, tags: Column) -> Column:
        """Without an element of these families that may be wanted, tags that cannot be wanted and hold nothing need no closer look."""
        ending = F.exists(tags, lambda t: t["maybe"] & t["tag"].isin(*_FAMILY))
        few = F.filter(tags, lambda t: t["maybe"] | ~t["tag"].isin(*markup.VOID_TAGS, *_FAMILY))
        return F.when(ending, tags).otherwise(bind(few, lambda some: unpaired(page_tokens, some)))

    def unpaired(page_tokens: Column, tags: Column) -> Column:
        def is_leaf(t: Column, end: Column) -> Column:
            matched = ~t["closer"] & ~t["maybe"] & end["closer"] & (end["tag"] == t["tag"])
            return F.coalesce(matched & ~markup.is_self_closed(F.get(page_tokens, t["pos"])), F.lit(False))

        stays = lambda t, i: ~is_leaf(t, F.get(tags, i + 1)) & ~(t["closer"] & is_leaf(F.get(tags, i - 1), t))
        return F.filter(tags, stays)

    def structure(page_tokens: Column) -> Column:
        # Positions, so that no text is copied.
        places = F.filter(F.transform(page_tokens, lambda _, i: i), lambda i: markup.is_tag(F.get(page_tokens, i)))
        seen = bind(F.transform(places, lambda i: named(F.get(page_tokens, i), i)), lambda tags: read_on(page_tokens, tags))
        entries = bind(F.transform(seen, lambda t: entry(page_tokens, t)), lasting)
        return F.transform(entries, lambda t: t.withField("page_tokens", F.size(page_tokens)))

    return bind(markup.tokens(F.col("html")), structure)


def _structure_rows(pages: DataFrame, key: str, carry: tuple[str, ...], anchors: bool) -> DataFrame:
    """One row per tag that bears on the structure, as :func:`tag_rows` gives them, with the end of a ``leaf``."""
    # The outer form, as in :func:`tag_rows`.
    tags = pages.select(key, *carry, F.explode_outer(_structure_tags(anchors)).alias("t")).where("t is not null")
    carried = [F.when(F.col("t.tag") == "a", F.col(name)).alias(name) for name in carry]
    names = ("page_tokens", "pos", "tag", "closer", "kind", "family", "noise", "unread", "selectors", "href", "meta", "leaf_end")
    return tags.select(key, *carried, *[F.col(f"t.{name}").alias(name) for name in names])


_PAYLOAD = ("noise", "unread", "selectors", "href", "meta")


def elements(pages: DataFrame, key: str = "page_id", carry: tuple[str, ...] = (), anchors: bool = True) -> DataFrame:
    """One row per element that is read for something (links with ``anchors``) or holds one: ``start``/``end`` token positions, parent span, flags.

    ``hidden`` marks elements inside removed boilerplate; ``cut_from``/``end``
    bound the part of the page that a boilerplate element removes.
    """
    rows = _structure_rows(pages, key, carry, anchors)
    pos, paired = F.col("pos"), F.col("kind") == "paired"
    opens, closes = paired & ~F.col("closer"), paired & F.col("closer")

    # Level of each tag among tags of its own name; stray end tags are ignored.
    by_tag = Window.partitionBy(key, "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("step", F.when(opens, 1).when(closes, -1).otherwise(0))
        .withColumn("sum_step", F.sum("step").over(by_tag))
        .withColumn("low", F.least(F.lit(0), F.min("sum_step").over(by_tag)))
        .withColumn("level", F.when(F.col("kind") != "leaf", F.col("sum_step") - F.col("low") + F.when(closes, 1).otherwise(0)))
    )

    # A start tag and the end tag that follows it on the same level are a pair.
    by_level = Window.partitionBy(key, "tag", "level").orderBy("pos")
    payload = F.struct(pos.alias("start"), *_PAYLOAD, *carry)
    rows = (
        rows.withColumn("next_closes", F.lead("closer").over(by_level))
        .withColumn("next_pos", F.lead("pos").over(by_level))
        .withColumn("prev_opens", ~F.lag("closer").over(by_level))
        .withColumn("opened", F.lag(payload).over(by_level))
        .withColumn(
            "pair_end",
            F.when(opens & F.col("next_closes"), F.col("next_pos")).when(
                opens & F.col("tag").isin("html", "body"), F.col("page_tokens")
            ),
        )
        .withColumn("pair_closer", closes & F.coalesce(F.col("prev_opens"), F.lit(False)))
        .withColumn("opened", F.when(F.col("pair_closer"), F.col("opened")))
    )

    # Depth among paired elements; the parent is the last one opened a level up.
    in_page = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    in_depth = Window.partitionBy(key, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    has_pair = F.col("pair_end").isNotNull()
    # Documents cut off before </body></html> still have a body as the parent.
    cut_off = has_pair & (F.col("pair_end") == F.col("page_tokens"))
    rows = (
        rows.withColumn(
            "depth", F.sum(F.when(has_pair, 1).when(F.col("pair_closer"), -1).otherwise(0)).over(in_page)
        )
        .withColumn("parent", F.last(F.when(has_pair, pos), ignorenulls=True).over(in_depth))
        .withColumn("parent_end", F.last("pair_end", ignorenulls=True).over(in_depth))
        # A paired element continues on its end tag's row, which knows the parent.
        .where(
            F.when(has_pair, cut_off).otherwise(
                F.col("pair_closer") | ~(closes | (F.col("kind") == "ignored"))
            )
        )
    )

    own = {name: F.when(F.col("pair_closer"), F.col(f"opened.{name}")).otherwise(F.col(name)) for name in (*_PAYLOAD, *carry)}
    ends_paragraph = F.col("tag").isin(*_BLOCKS)
    in_family = Window.partitionBy(key, "parent", "family").orderBy("start")
    rows = rows.select(
        key,
        "page_tokens",
        "tag",
        "kind",
        F.coalesce(F.col("family"), F.when(ends_paragraph, F.lit("p"))).alias("family"),
        (F.col("closer") & ~F.col("pair_closer")).alias("boundary"),
        F.when(F.col("pair_closer"), F.col("opened.start")).otherwise(pos).alias("start"),
        F.when(F.col("pair_closer"), pos).otherwise(F.col("leaf_end")).alias("pair_end"),
        F.when(cut_off, -1).otherwise(F.coalesce("parent", F.lit(-1))).alias("parent"),
        F.coalesce("parent_end", F.col("page_tokens")).alias("parent_end"),
        *[value.alias(name) for name, value in own.items()],
    )
    # Other families than "p" also end paragraphs, so they take part there too.
    crossing = F.col("family").isin("li", "dt", "td", "tr")
    rows = rows.withColumn(
        "family",
        F.explode(F.when(crossing, F.array(F.col("family"), F.lit("p"))).otherwise(F.array(F.col("family")))),
    )
    rows = (
        rows.withColumn("next_start", F.lead("start").over(in_family))
        .withColumn("next_boundary", F.lead("boundary").over(in_family))
        .where(~F.col("boundary") & F.coalesce((F.col("family") != "p") | ~F.col("tag").isin("li", "dt", "dd", "td", "th", "tr"), F.lit(True)))
    )
    implied_end = F.coalesce(
        F.when(F.col("next_boundary"), F.col("next_start")).otherwise(F.col("next_start") - 1),
        F.col("parent_end") - 1,
    )
    end = (
        F.when(F.col("kind") == "void", F.col("start"))
        .when(F.col("pair_end").isNotNull(), F.col("pair_end"))
        .when(F.col("kind") == "implied", implied_end)
        .otherwise(F.col("parent_end") - 1)
    )
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("end", end)
    rows = rows.withColumn(
        "noise_until", F.coalesce(F.max(F.when(F.col("noise"), F.col("end"))).over(before), F.lit(-1))
    ).withColumn(
        "unread_until", F.coalesce(F.max(F.when(F.col("unread"), F.col("end"))).over(before), F.lit(-1))
    )
    return rows.select(
        key,
        "page_tokens",
        "tag",
        "start",
        "end",
        "parent",
        "parent_end",
        "selectors",
        "href",
        "meta",
        *carry,
        (F.col("noise") | (F.col("noise_until") >= F.col("start"))).alias("hidden"),
        F.when(
            F.col("unread") & (F.col("end") > F.col("unread_until")),
            F.greatest(F.col("start"), F.col("unread_until") + 1),
        ).alias("cut_from"),
    )
