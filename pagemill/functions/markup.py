"""HTML tokens: splitting a page into tags and text, and reading attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import SPACE

# Comments, scripts and styles hold no markup. They are read left to right in one
# alternation, so a comment may hold "<script>" and a script may hold "<!--".
_OPAQUE = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z))"
)

# A tag (quoted attribute values may hold ">"), a tag with a broken quote, a
# declaration, or a run of text in which a stray "<" is just a character. The
# possessive quantifiers keep long tags from deepening the matcher's stack.
_TOKEN = (
    r"</?[A-Za-z](?:[^'\">]+|\"[^\"]*\"|'[^']*')*+>"
    r"|</?[A-Za-z][^>]*(?:>|\z)"
    r"|<[!?/][^>]*(?:>|\z)"
    r"|(?:[^<]+|<(?![A-Za-z!?/]))++"
)

# Walks over whole attributes up to the named one, so that text inside another
# attribute's value is never taken for it.
_ATTRIBUTE = (
    r"(?is)^<[a-z][^\s/>]*+"
    r"(?:[\s/]*+(?!NAME[\s=/>])[^\s=/>\"']++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+|[\s/]*+[\"'=])*+"
    r"[\s/]*+(NAME)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"
)

VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")


def tokens(html: Column) -> Column:
    """Array of tags, declarations and text runs of a page, in order."""
    return F.regexp_extract_all(F.regexp_replace(html, _OPAQUE, "<!-- -->"), F.lit(_TOKEN), F.lit(0))


def is_markup(token: Column) -> Column:
    return token.startswith("<") & token.rlike("^<[A-Za-z!?/]")


def is_tag(token: Column) -> Column:
    return token.startswith("<") & token.rlike("^</?[A-Za-z]")


def raw_name(token: Column) -> Column:
    return F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1)


def tag_name(token: Column) -> Column:
    return F.lower(raw_name(token))


def is_closer(token: Column) -> Column:
    return token.startswith("</")


def is_self_closed(token: Column) -> Column:
    return token.endswith("/>") & ~token.rlike(r"=[^\s\"'>]+/>$")


def attribute(token: Column, name: str) -> Column:
    """Value of a start tag's attribute, references undecoded; null when absent."""
    pattern = _ATTRIBUTE.replace("NAME", name)
    quoted = F.regexp_extract(token, pattern, 2)
    value = F.regexp_replace(quoted, r"^([\"'])([\s\S]*)\1$", "$2")
    # The plain substring test spares most tags the pattern.
    mentioned = F.contains(F.lower(token), F.lit(name))
    return F.when(mentioned & (F.regexp_extract(token, pattern, 1) != ""), value)


def is_blank(text: Column) -> Column:
    """True for text made of whitespace and no-break-space references only."""
    return text.rlike(rf"^(?:[{SPACE}]++|&(?:nbsp|#160|#[xX]0*[aA]0);?)*+\z")
