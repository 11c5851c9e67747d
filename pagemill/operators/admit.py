"""Rules that decide which URLs are worth following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.memo import kept_columns
from pagemill.functions.text import bind
from pagemill.functions.urls import url_path
from pagemill.operators.seen import SeenIndex

# File types that are no pages.
SKIPPED_EXTENSIONS = (
    "pdf", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "xml", "rss", "atom", "zip", "tar", "gz", "bz2", "7z", "rar",
    "mp3", "mp4", "wav", "avi", "mov", "webm", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "woff", "woff2", "ttf", "eot", "json", "csv", "tsv",
)
# Path segments that rarely hold content.
NON_CONTENT = (
    "(?i)/(?:login|logout|signin|signup|register|reset-password|search|admin|dashboard|settings|preferences"
    r"|api/|cgi-bin/|wp-admin|wp-json|cart|checkout|account|billing|print/|raw/|edit/|action=)(?:/|$|\?)"
)


def rule_violation(url: Column, prefix: str | None = None, regex: str | None = None) -> Column:
    """First rule a URL breaks: extension, non_content, prefix, regex; null if none."""

    def check(path: Column) -> Column:
        suffix = F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1)
        reason = F.when(suffix.isin(*SKIPPED_EXTENSIONS), "extension").when(path.rlike(NON_CONTENT), "non_content")
        if prefix:
            reason = reason.when(~F.lower(path).startswith(prefix.lower()), "prefix")
        if regex:
            reason = reason.when(~path.rlike(regex), "regex")
        return reason

    return bind(url_path(url), check)


@kept_columns
def url_rule(prefix: str | None = None, regex: str | None = None) -> Column:
    """The rule of :func:`rule_violation` for the column ``url``."""
    return rule_violation(F.col("url"), prefix, regex)


def admit_urls(
    urls: DataFrame,
    seen: DataFrame | None = None,
    order: str = "rank",
    prefix: str | None = None,
    regex: str | None = None,
) -> DataFrame:
    """Add ``reject_reason`` to every URL occurrence; null means admitted.

    The first occurrence by ``order`` is judged by the rules, later ones and URLs
    in ``seen`` are duplicates, whatever the rules say.
    """
    first = urls.groupBy("url").agg(F.min(order).alias(order))
    if seen is not None:
        first = first.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_seen"), "duplicate").otherwise(url_rule(prefix, regex))
    judged = first.select("url", order, F.lit(True).alias("_first"), reason.alias("_reason"))
    # Only first occurrences find a partner. With the order in the key, the many
    # occurrences of a popular URL spread over all tasks.
    return urls.join(judged, ["url", order], "left").select(
        *urls.columns,
        F.when(F.col("_first"), F.col("_reason")).otherwise(F.lit("duplicate")).alias("reject_reason"),
    )


def reject_counts(
    urls: DataFrame,
    seen: DataFrame | None = None,
    prefix: str | None = None,
    regex: str | None = None,
) -> DataFrame:
    """``(reason, urls)``: occurrences per reject reason, ``admitted`` for the rest.

    The same as counting :func:`admit_urls`, from one pass: all but one occurrence of
    a URL are duplicates, whichever comes first.
    """
    once = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    stored = F.lit(False)
    if seen is not None:
        once = once.join(seen.select("url").distinct().withColumn("_seen", F.lit(True)), "url", "left")
        stored = F.coalesce("_seen", F.lit(False))
    reason = F.when(stored, "duplicate").otherwise(F.coalesce(url_rule(prefix, regex), F.lit("admitted")))
    parts = F.array(F.struct(reason.alias("reason"), F.lit(1).cast("bigint").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n")))
    return once.select(F.inline(parts)).groupBy("reason").agg(F.sum("n").alias("urls")).where("urls > 0")


def admitted_urls(
    urls: DataFrame,
    seen: DataFrame | SeenIndex,
    order: str = "rank",
    prefix: str | None = None,
    regex: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Only the admitted URLs, each once with its first ``order`` value.

    ``keep`` names further columns to take from the first occurrence. ``seen`` is a table
    of URLs or the stored index of earlier runs.
    """
    first = urls.groupBy("url").agg(
        F.min(order).alias(order), *[F.min_by(name, order).alias(name) for name in keep]
    )
    allowed = first.where(url_rule(prefix, regex).isNull())
    return seen.unseen(allowed) if isinstance(seen, SeenIndex) else allowed.join(seen.select("url"), "url", "left_anti")


def seen_count(*urls: DataFrame) -> DataFrame:
    """Number of distinct URLs in all tables together."""
    together = urls[0].select("url")
    for more in urls[1:]:
        together = together.unionByName(more.select("url"))
    return together.agg(F.count_distinct("url").alias("seen"))
