"""Statistics of a document collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.sizing import cut_lineage


def _percent(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part * F.lit(100.0), whole), 1)


def overview(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("source").alias("sources"),
        F.min("fetched_at").alias("first_fetch"),
        F.max("fetched_at").alias("last_fetch"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"),
        F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"),
    )


def mean_words(documents: DataFrame) -> DataFrame:
    return documents.agg(F.bround(F.avg("word_count"), 0).cast("bigint").alias("mean_words"))


def _with_share(groups: DataFrame) -> DataFrame:
    total = groups.agg(F.sum("documents")).scalar()
    return groups.withColumn("percent", _percent(F.col("documents"), total))


def type_breakdown(documents: DataFrame) -> DataFrame:
    """Documents, share and mean words per content type; the ``null`` bucket's mean is 0."""
    groups = documents.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("documents"), F.bround(F.avg("word_count"), 0).cast("bigint").alias("mean_words")
    )
    labelled = groups.select(
        F.coalesce("content_type", F.lit("null")).alias("content_type"),
        "documents",
        F.when(F.col("content_type").isNull(), 0).otherwise(F.coalesce("mean_words", F.lit(0))).cast("bigint").alias("mean_words"),
    )
    # A literal "null" type and missing types share a bucket.
    merged = labelled.groupBy("content_type").agg(
        F.sum("documents").alias("documents"), F.max("mean_words").alias("mean_words")
    )
    return _with_share(merged).select("content_type", "documents", "percent", "mean_words").orderBy(
        F.desc("documents"), "content_type"
    )


def language_breakdown(documents: DataFrame) -> DataFrame:
    groups = documents.groupBy(F.coalesce("language", F.lit("undetected")).alias("language")).agg(
        F.count(F.lit(1)).alias("documents")
    )
    return _with_share(groups).select("language", "documents", "percent").orderBy(F.desc("documents"), "language")


def is_ready(documents: DataFrame) -> Column:
    """At least 50 words, a known language and a text share above 0.03 (NaN fails)."""
    if "text_to_html_ratio" not in documents.columns:
        return F.lit(False)
    ratio = F.col("text_to_html_ratio").cast("double")
    enough = (F.col("word_count") >= 50) & F.col("language").isNotNull() & ~F.isnan(ratio) & (ratio > 0.03)
    return F.coalesce(enough, F.lit(False))


def readiness(documents: DataFrame) -> DataFrame:
    counts = documents.agg(F.count_if(is_ready(documents)).alias("ready"), F.count(F.lit(1)).alias("documents"))
    return counts.select(
        "ready",
        "documents",
        F.coalesce(_percent(F.col("ready"), F.col("documents")), F.lit(0.0)).alias("percent"),
        (F.col("documents") - F.col("ready")).alias("filtered_out"),
    )


def count_on_domain(documents: DataFrame, domain: str) -> DataFrame:
    return documents.agg(F.count_if(F.col("source") == domain).alias("documents"))


def first_source(documents: DataFrame, order: str) -> DataFrame:
    return documents.agg(F.coalesce(F.min_by("source", order), F.lit("unknown")).alias("source"))


def report(documents: DataFrame, order: str = "doc_id") -> DataFrame:
    """All numbers of the report as ``(section, key, metric, value)``.

    One aggregation by type, language and readiness is written to the checkpoint
    folder (a row per combination), and the sections are read from it; only the
    distinct sources need a pass of their own.
    """
    ready = is_ready(documents).alias("ready")
    cube = cut_lineage(documents.groupBy("content_type", "language", ready).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("word_count").alias("words"),
        F.count("word_count").alias("worded"),
        F.sum("char_count").alias("chars"),
        F.min("fetched_at").alias("first_fetch"),
        F.max("fetched_at").alias("last_fetch"),
    ))
    sources = documents.agg(F.count_distinct("source").alias("sources"), F.min_by("source", order).alias("source"))
    times = cube.agg(F.min("first_fetch").alias("first_fetch"), F.max("last_fetch").alias("last_fetch"))
    return sections(cube, sources.withColumns({name: times.select(name).scalar() for name in times.columns}))


def sections(cube: DataFrame, whole_table: DataFrame) -> DataFrame:
    """The report from counts by ``(content_type, language, ready)`` and one row of ``sources, source, first_fetch, last_fetch``."""

    def rows(df: DataFrame, section: str, label: Column, metrics: dict[str, Column]) -> DataFrame:
        entries = F.array(
            *[F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value")) for name, value in metrics.items()]
        )
        return df.select(F.lit(section).alias("section"), label.alias("key"), F.inline(entries))

    mean = lambda words, n: F.bround(F.try_divide(words.cast("double"), n), 0).cast("bigint")
    whole = cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("ready"), F.col("n")).otherwise(0)), F.lit(0)).alias("ready"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.sum("worded").alias("worded"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
    )
    by_type = cube.groupBy("content_type").agg(
        F.sum("n").alias("documents"), F.sum("words").alias("words"), F.sum("worded").alias("worded")
    )
    by_type = _with_share(by_type).withColumn(
        "mean", F.when(F.col("content_type").isNull(), 0).otherwise(F.coalesce(mean(F.col("words"), F.col("worded")), F.lit(0)))
    )
    by_language = _with_share(cube.groupBy("language").agg(F.sum("n").alias("documents")))
    everything = F.lit("all")
    n, is_in = F.col("n"), F.col("ready")
    parts = [
        rows(whole, "overview", everything, {
            "documents": n, "words": F.col("words"), "chars": F.col("chars"), "mean_words": mean(F.col("words"), F.col("worded")),
        }),
        rows(whole_table, "overview", everything, {
            "sources": F.col("sources"), "first_fetch": F.col("first_fetch"), "last_fetch": F.col("last_fetch"), "first_source": F.coalesce("source", F.lit("unknown")),
        }),
        rows(by_type, "content_type", F.coalesce("content_type", F.lit("null")), {
            "documents": F.col("documents"), "percent": F.col("percent"), "mean_words": F.col("mean"),
        }),
        rows(by_language, "language", F.coalesce("language", F.lit("undetected")), {
            "documents": F.col("documents"), "percent": F.col("percent"),
        }),
        rows(whole, "readiness", everything, {
            "ready": is_in, "documents": n, "percent": F.coalesce(_percent(is_in, n), F.lit(0.0)), "filtered_out": n - is_in,
        }),
    ]
    return reduce(DataFrame.unionByName, parts)
