"""The report of a store, kept up to date batch by batch.

Beside each batch lie the sums that it adds: its documents' contributions, less those of
the stored documents that they replace. A contribution is counted by (content type,
language, readiness), by fetch time and by source, so that shares, extremes and distinct
counts follow from sums. The report then reads sums, not documents.

A batch's sums are found before its rows are written, from the rows of all other
batches. Doing the batch again gives the same sums and overwrites them. They hold for one
writer at a time: batches of streams that run at once may replace one document twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.plans.report import is_ready, sections
from pagemill.sources.files import path_exists

_SUMS = "kind string, content_type string, language string, ready boolean, value string, n bigint, words bigint, worded bigint, chars bigint"
_FACTS = ("content_type", "language", "ready", "fetched_at", "source", "word_count", "char_count")


def facts(documents: DataFrame, *keep: str) -> DataFrame:
    """What a document contributes; ``keep`` passes further columns on."""
    return documents.withColumn("ready", is_ready(documents)).select(*_FACTS, *keep)


def _contributions(own: Column, sign: int) -> Column:
    """A document's rows of sums."""
    nothing = F.lit(None).cast("string")

    def row(kind: str, value: Column, cube: bool) -> Column:
        amount = lambda c: F.coalesce(c, F.lit(0)).cast("bigint") * sign
        key = lambda name: own[name] if cube else F.lit(None)
        measure = lambda c: amount(c) if cube else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(kind).alias("kind"), key("content_type").cast("string").alias("content_type"), key("language").cast("string").alias("language"),
            key("ready").cast("boolean").alias("ready"), value.alias("value"), F.lit(sign).cast("bigint").alias("n"), measure(own["word_count"]).alias("words"),
            measure(own["word_count"].isNotNull().cast("int")).alias("worded"), measure(own["char_count"]).alias("chars"),
        )

    return F.array(row("cube", nothing, True), row("fetched", own["fetched_at"], False), row("source", own["source"], False))


def changes(new: DataFrame, current: DataFrame, version: str = "version") -> DataFrame:
    """The sums that ``new`` rows add to those of ``current`` ones; a row counts if its version is higher than the stored one.

    Both hold ``doc_id`` once. Rows that are hashed by it are joined where they are.
    """
    packed = lambda df, name: facts(df, "doc_id", version).select("doc_id", F.struct(*_FACTS, F.col(version).alias("version")).alias(name))
    met = packed(new, "new").join(packed(current, "old"), "doc_id", "left")
    met = met.where(F.col("old").isNull() | (F.col("new.version") > F.col("old.version")))
    gone = F.when(F.col("old").isNotNull(), _contributions(F.col("old"), -1))
    rows = met.select(F.inline(F.flatten(F.array_compact(F.array(_contributions(F.col("new"), 1), gone)))))
    keys = ["kind", "content_type", "language", "ready", "value"]
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "words", "worded", "chars")])
    # Ids never leave a store, and an id's source never changes: the first of each batch is enough.
    first = met.agg(F.min(F.struct("doc_id", F.col("new.source").alias("source"))).alias("x")).where("x IS NOT NULL")
    first = first.select(F.lit("first").alias("kind"), F.col("x.doc_id").alias("content_type"), F.lit(None).cast("string").alias("language"),
                         F.lit(None).cast("boolean").alias("ready"), F.col("x.source").alias("value"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "words", "worded", "chars")])
    return sums.unionByName(first)


def write_sums(sums: DataFrame, store: str, run: str, batch_id: int) -> None:
    sums.coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/_sums/{run}-{batch_id}")


def store_report(spark: SparkSession, store: str) -> DataFrame:
    """As :func:`pagemill.plans.report.report` of the store's documents, from the sums alone."""
    place = f"{store.rstrip('/')}/_sums"
    every = spark.read.schema(_SUMS).parquet(f"{place}/*") if path_exists(spark, place) else spark.createDataFrame([], _SUMS)
    keys = ["kind", "content_type", "language", "ready", "value"]
    sums = every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "words", "worded", "chars")])
    cube = sums.where("kind = 'cube' AND n > 0").select("content_type", "language", "ready", "n", "words", "worded", "chars")
    left = sums.where("n > 0")
    whole = left.agg(
        F.count_if((F.col("kind") == "source") & F.col("value").isNotNull()).alias("sources"),
        F.min(F.when(F.col("kind") == "fetched", F.col("value"))).alias("first_fetch"),
        F.max(F.when(F.col("kind") == "fetched", F.col("value"))).alias("last_fetch"),
    )
    first = every.where("kind = 'first'").agg(F.min(F.struct("content_type", "value")).alias("x")).select(F.col("x.value").alias("source"))
    # One row each.
    return sections(cube, whole.withColumn("source", first.scalar()))
