"""URL parsing, canonical form, identity and reference resolution.

All functions map Column to Column and stay inside the JVM. Spark's own
``parse_url`` is not used: it refuses hosts with ``_`` and paths with spaces.
A URL is split once into a struct of parts; everything else reads its fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind

# Component grammar of RFC 3986, appendix B, with the scheme's alphabet spelt out.
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"

# Query keys that never change what a page shows.
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")

# Schemes in which relative references are resolved.
_RELATIVE_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                     "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
                     "svn+ssh", "ws", "wss")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _has(text: Column, needle: str) -> Column:
    return F.contains(text, F.lit(needle))


def _split_uri(url: Column) -> Column:
    """Struct of scheme, authority, path (with parameters), query and fragment."""
    tidy = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    return bind(
        tidy,
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, _URI, 1)).alias("scheme"),
            F.regexp_extract(u, _URI, 2).alias("authority"),
            F.regexp_extract(u, _URI, 3).alias("raw_path"),
            F.regexp_extract(u, _URI, 4).alias("query"),
            F.regexp_extract(u, _URI, 5).alias("fragment"),
        ),
    )


def _bare_path(raw_path: Column) -> Column:
    return F.regexp_replace(raw_path, r";[^/]*$", "")


def _params(raw_path: Column) -> Column:
    return F.regexp_extract(raw_path, r";([^/]*)$", 1)


def _host_and_port(authority: Column) -> Column:
    """Struct of lower-cased host and port text; user info is dropped."""
    return bind(
        F.regexp_replace(authority, "^.*@", ""),
        lambda a: F.when(
            _has(a, "["),
            F.struct(
                F.lower(F.regexp_extract(a, r"\[([^\]]*)", 1)).alias("host"),
                F.regexp_extract(a, r"\[[^\]]*\][^:]*:(.*)$", 1).alias("port"),
            ),
        ).otherwise(
            F.struct(
                F.lower(F.regexp_extract(a, "^([^:]*)", 1)).alias("host"),
                F.regexp_extract(a, "^[^:]*:(.*)$", 1).alias("port"),
            )
        ),
    )


def _reason(authority: Column, port: Column) -> Column:
    in_range = port.rlike("^[0-9]+$") & F.coalesce(port.try_cast("bigint") <= 65535, F.lit(False))
    return F.when(_has(authority, "[") != _has(authority, "]"), F.lit("bad_host")).when(
        (port != "") & ~in_range, F.lit("bad_port")
    )


def url_path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    tidy = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    return _bare_path(F.regexp_extract(tidy, _URI, 3))


def url_domain(url: Column) -> Column:
    """Lower-cased host name, ``''`` when there is none."""
    tidy = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    host = _host_and_port(F.regexp_extract(tidy, _URI, 2))["host"]
    return F.coalesce(host, F.lit(""))


def url_error(url: Column) -> Column:
    """Why a URL has no canonical form (``bad_host``, ``bad_port``), else null."""
    return bind(
        _split_uri(url),
        lambda u: _reason(u["authority"], _host_and_port(u["authority"])["port"]),
    )


def _unquote(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quote(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _canonical_query(query: Column, sort_query: bool) -> Column:
    def write(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        if sort_query:
            keys = F.array_sort(keys)
        by_key = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))
        return F.array_join(
            F.transform(by_key, lambda p: F.concat(_quote(p["k"]), F.lit("="), _quote(p["v"]))), "&"
        )

    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _unquote(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _unquote(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v"),
        ),
    )
    return bind(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS)), write)


def _assemble(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    hier = (
        F.when(authority != "", F.concat(F.lit("//"), authority, rooted))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(
            (scheme != "") & scheme.isin(*_RELATIVE_SCHEMES) & ((path == "") | path.startswith("/")),
            F.concat(F.lit("//"), path),
        )
        .otherwise(path)
    )
    prefix = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    suffix = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    return F.concat(prefix, hier, suffix)


def normalize_url(url: Column, sort_query: bool = False) -> Column:
    """Canonical form of a URL; null when :func:`url_error` names a reason.

    Lower-cases scheme and host, drops user info, default ports, path
    parameters, index file names, tracking keys and the fragment, and re-encodes
    the query. Keys keep their first-seen order unless ``sort_query`` is set.
    """

    def canonical(u: Column, at: Column) -> Column:
        # Most URLs name no port, and a failed cast is an exception each time.
        port = F.when(at["port"] != "", at["port"].try_cast("int"))
        default = ((u["scheme"] == "http") & (port == 80)) | ((u["scheme"] == "https") & (port == 443))
        shown = F.when((port > 0) & ~default, F.concat(F.lit(":"), port.cast("string"))).otherwise("")
        path = F.regexp_replace(
            F.regexp_replace(_bare_path(u["raw_path"]), "^$", "/"),
            r"/(?:index|default)\.html?$", "/",
        )
        query = F.when(u["query"] == "", F.lit("")).otherwise(_canonical_query(u["query"], sort_query))
        ready = F.struct(path.alias("path"), query.alias("query"), F.concat(at["host"], shown).alias("authority"))
        whole = bind(ready, lambda r: _assemble(u["scheme"], r["authority"], r["path"], r["query"]))
        return F.when(_reason(u["authority"], at["port"]).isNull(), whole)

    return bind(
        _split_uri(url), lambda u: bind(_host_and_port(u["authority"]), lambda at: canonical(u, at))
    )


def document_id(url: Column) -> Column:
    """First 16 hex digits of the URL's SHA-256."""
    return F.left(F.sha2(url, 256), F.lit(16))


def _remove_dots(segments: Column) -> Column:
    walked = F.aggregate(
        segments,
        _no_strings(),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(_no_strings())
    return F.array_join(F.concat(walked, tail), "/")


def _merge_paths(base_path: Column, ref_path: Column) -> Column:
    """Segments of a relative path appended to the folder of the base path."""
    folder = bind(
        F.split(base_path, "/"),
        lambda parts: F.when(
            F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )
    # Empty segments in the middle are dropped, the first and last are kept.
    return bind(
        F.concat(folder, F.split(ref_path, "/")),
        lambda m: F.concat(
            F.slice(m, 1, 1),
            F.filter(F.slice(m, F.lit(2), F.greatest(F.size(m) - 2, F.lit(0))), lambda s: s != ""),
            F.when(F.size(m) > 1, F.slice(m, -1, 1)).otherwise(_no_strings()),
        ),
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on page ``base``."""

    def resolved(b: Column, r: Column) -> Column:
        scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
        base_path, ref_path = _bare_path(b["raw_path"]), _bare_path(r["raw_path"])
        segments = F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(
            _merge_paths(base_path, ref_path)
        )
        merged = F.regexp_replace(bind(segments, _remove_dots), "^$", "/")
        own, empty = r["authority"] != "", r["raw_path"].isin("", ";")
        path = F.when(own, ref_path).when(empty, base_path).otherwise(merged)
        params = F.when(empty & ~own, _params(b["raw_path"])).otherwise(_params(r["raw_path"]))
        target = F.struct(
            scheme.alias("scheme"),
            F.when(own, r["authority"]).otherwise(b["authority"]).alias("authority"),
            F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path).alias("path"),
            F.when(empty & ~own & (r["query"] == ""), b["query"]).otherwise(r["query"]).alias("query"),
        )
        fragment = F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise("")
        joined = bind(target, lambda t: _assemble(t["scheme"], t["authority"], t["path"], t["query"]))
        foreign = (scheme != b["scheme"]) | ~scheme.isin(*_RELATIVE_SCHEMES)
        return (
            F.when(base == "", ref)
            .when(ref == "", base)
            .when(foreign, ref)
            .otherwise(F.concat(joined, fragment))
        )

    return bind(_split_uri(base), lambda b: bind(_split_uri(ref), lambda r: resolved(b, r)))
