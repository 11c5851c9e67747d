"""Decoding of HTML character references as one native expression.

Names are the HTML 4 set of the Python standard library (plus ``&apos;``). A
Latin-1 name may lack its semicolon, as browsers allow.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind

# Searched first: these names make up nearly all references in real pages.
_FREQUENT = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot")


def _table() -> Column:
    # One literal that the optimizer folds into a map.
    names = {f"{name};": chr(code) for name, code in name2codepoint.items()} | {"apos;": "'"}
    names |= {name: names[f"{name};"] for name in html5 if f"{name};" in names}
    ranked = sorted(names, key=lambda name: (name.rstrip(";") not in _FREQUENT, name))
    written = "\x02".join(f"&{name}\x01{names[name]}" for name in ranked)
    return F.str_to_map(F.lit(written), F.lit("\x02"), F.lit("\x01"))


def _from_number(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#0*([0-9]+)", 1)
    hexes = F.regexp_extract(piece, "^&#[xX]0*([0-9A-Fa-f]+)", 1)
    number = (
        F.when(F.length(digits).between(1, 9), digits)
        .when(F.length(hexes).between(1, 6), F.conv(hexes, 16, 10))
        .try_cast("bigint")
    )
    # Code points 128-159 mean the Windows-1252 characters in HTML.
    latin = bytes(range(128, 160)).decode("cp1252", "replace")

    def character(cp: Column) -> Column:
        valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
        return (
            F.when(cp.between(128, 159), F.substr(F.lit(latin), (cp - 127).cast("int"), F.lit(1)))
            .when(valid, utf32)
            .otherwise(F.lit("\N{REPLACEMENT CHARACTER}"))
        )

    return bind(number, character)


# A reference, or the text up to the next "&"; an "&" that starts no reference stands alone.
_PIECE = r"[^&]++|&(?:#(?:[0-9]++|[xX][0-9A-Fa-f]++);?|[A-Za-z][A-Za-z0-9]*+;?)?+"
_REFERENCE = r"&(?:#(?:[0-9]++|[xX][0-9A-Fa-f]++);?|[A-Za-z][A-Za-z0-9]*+;?)"
# With more different references a text is put together from its pieces.
_FEW = 64
# Non-characters: one stands before what was put in, the other for an "&" in it.
_START, _AMP = "\ufdd0", "\ufdd1"


def _decoded(piece: Column) -> Column:
    return (
        F.when(~piece.startswith("&"), piece)
        .when(piece.startswith("&#"), _from_number(piece))
        .otherwise(F.coalesce(F.element_at(_table(), piece), piece))
    )


def _by_piece(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), _decoded), "")


def _by_reference(text: Column, found: Column) -> Column:
    """Each different reference is replaced in the whole text, longer ones first, so that none is taken for the start of another.

    What is put in starts with a mark and holds no "&", so it joins with nothing around it to a reference.
    """
    put = F.transform(found, lambda r: F.struct(F.length(r).alias("size"), r.alias("ref"), F.concat(F.lit(_START), F.replace(_decoded(r), F.lit("&"), F.lit(_AMP))).alias("put")))
    marked = F.aggregate(F.sort_array(put, asc=False), text, lambda done, r: F.replace(done, r["ref"], r["put"]))
    return F.replace(F.replace(marked, F.lit(_START), F.lit("")), F.lit(_AMP), F.lit("&"))


def _plain(text: Column) -> Column:
    return ~F.contains(text, F.lit(_START)) & ~F.contains(text, F.lit(_AMP))


def decode_entities(text: Column) -> Column:
    """Replace character references once, left to right (``&amp;lt;`` gives ``&lt;``).

    A text has few different references as a rule, so each of them is decoded once per text.
    """

    def decoded(t: Column) -> Column:
        # What follows an "&" up to the next one, each once, holds every reference there is.
        parts = F.array_join(F.array_distinct(F.split(t, "&")), "&")
        found = F.array_distinct(F.regexp_extract_all(F.concat(F.lit("&"), parts), F.lit(_REFERENCE), F.lit(0)))
        few = lambda refs: (F.size(refs) <= _FEW) & _plain(t) & ~F.exists(refs, lambda r: r.startswith("&#") & ~_plain(_from_number(r)))
        whole = bind(found, lambda refs: F.when(few(refs), _by_reference(t, refs)).otherwise(_by_piece(t)))
        return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)

    return bind(text, decoded)
