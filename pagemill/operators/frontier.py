"""Breadth-first link expansion from a seed, level by level.

The driver loops over depths only; rows stay distributed. What a walk has queued is
one table bucketed by URL, and so is what is known of each URL beforehand. The links
of a level are reduced to first occurrences, which exchanges that frontier once by URL; the
anti join on what was queued and the join that visits the URLs read buckets in place.
First-in-first-out order needs no numbering: a URL's rank is the list of link places on
its way from the seed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.operators.admit import url_rule
from pagemill.operators.bucketed import BucketedTable
from pagemill.operators.sizing import checkpoint_folder, global_rank

LINKS = "array<struct<rank:bigint,link:string>>"
_QUEUE = {"url": "string", "depth": "int", "parent_url": "string", "rank": "array<bigint>", "outcome": "string", "links": LINKS}
_GRAPH = {"url": "string", "outcome": "string", "links": LINKS}
#: Ranks become single numbers again after so many levels.
_LONGEST_RANK = 32

#: ``(url, parent_url, rank)`` of a level and its depth -> the same with ``outcome`` and ``links``.
Visit = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Expansion:
    """Tasks popped from the queue ``(url, depth, parent_url, rank, outcome)``.

    ``outcome`` is ``saved``, ``empty`` (no text) or ``failed`` (no page). Within a depth
    tasks are ordered by ``rank``, a list of numbers.
    """

    tasks: DataFrame

    def counters(self) -> DataFrame:
        """One row: pages fetched, failed and saved."""
        return self.tasks.agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count_if(F.col("outcome") == "failed").alias("failed"),
            F.count_if(F.col("outcome") == "saved").alias("saved"),
        )


def walk_buckets(outcomes: DataFrame) -> int:
    """As many buckets as an exchange has partitions, so that a level's exchange meets them as they are."""
    return int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def known_graph(outcomes: DataFrame, links: DataFrame) -> BucketedTable:
    """``(url, outcome)`` and ``(url, rank, link)`` as one table bucketed by URL, a row per fetchable URL."""
    spark = outcomes.sparkSession
    table = BucketedTable.open(spark, f"{checkpoint_folder(spark)}/graph-{uuid.uuid4().hex}", _GRAPH, "url", walk_buckets(outcomes))
    listed = links.groupBy("url").agg(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "link")).alias("links"))
    table.append(outcomes.select("url", "outcome").repartition(table.buckets, "url").join(listed, "url", "left"))
    return table


def expand_links(
    start_url: str,
    outcomes: DataFrame,
    links: DataFrame,
    max_depth: int = 2,
    max_pages: int | None = None,
    existing_urls: DataFrame | None = None,
    existing_on_domain: int = 0,
    prefix: str | None = None,
    regex: str | None = None,
    refresh: bool = False,
) -> Expansion:
    """Follow links from ``start_url`` in first-in-first-out order.

    ``outcomes`` holds ``(url, outcome)`` per fetchable URL, ``links`` holds
    ``(url, rank, link)`` per page. The walk ends when saved pages reach
    ``max_pages`` (those already stored on the domain count) or at ``max_depth``.
    Stored URLs count as seen: with the seed among them nothing is fetched,
    unless ``refresh`` is set.
    """
    graph = known_graph(outcomes, links)

    def visit(level: DataFrame, _: int) -> DataFrame:
        return level.join(graph.read(), "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))

    try:
        return walk(outcomes.sparkSession, start_url, visit, max_depth, max_pages, None if refresh else existing_urls, existing_on_domain, prefix, regex)
    finally:
        graph.drop()


def next_level(queue: DataFrame, depth: int, prefix: str | None = None, regex: str | None = None) -> DataFrame:
    """``(url, parent_url, rank)`` that the saved pages of ``depth`` link to first and that were not queued before."""
    saved = queue.where((F.col("depth") == depth) & (F.col("outcome") == "saved"))
    found = saved.select(F.col("url").alias("parent_url"), F.col("rank").alias("way"), F.inline("links").alias("place", "url"))
    # First occurrence per link; partial aggregation absorbs popular targets before the exchange.
    first = found.groupBy("url").agg(F.min(F.struct(F.concat("way", F.array("place")).alias("rank"), "parent_url")).alias("at"))
    admitted = first.where(url_rule(prefix, regex).isNull())
    return admitted.join(queue.select("url"), "url", "left_anti").select("url", "at.parent_url", "at.rank")


def walk(
    spark: SparkSession,
    start_url: str,
    visit: Visit,
    max_depth: int = 2,
    max_pages: int | None = None,
    seen_urls: DataFrame | None = None,
    existing_on_domain: int = 0,
    prefix: str | None = None,
    regex: str | None = None,
) -> Expansion:
    """As :func:`expand_links`, where ``visit`` finds outcome and links of each level's URLs.

    ``visit`` should keep the rows hashed by URL, so that a level is written as it is.
    """
    path = f"{checkpoint_folder(spark)}/walk-{uuid.uuid4().hex}"
    queue = BucketedTable.open(spark, path, _QUEUE, "url", walk_buckets(spark.range(1)))
    try:
        kept = _levels(queue, start_url, visit, max_depth, max_pages, seen_urls, existing_on_domain, prefix, regex)
    finally:
        queue.drop()
    # Read by path, since the catalogue's entry is gone.
    return Expansion(spark.read.schema(queue.ddl).parquet(path).where(kept).select("url", "depth", "parent_url", "rank", "outcome"))


def _levels(
    queue: BucketedTable, start_url: str, visit: Visit, max_depth: int, max_pages: int | None, seen_urls: DataFrame | None, existing_on_domain: int,
    prefix: str | None, regex: str | None,
) -> Column:
    """Fill the queue's table; the condition that its rows within the walk meet. Stored URLs have depth -1."""
    spark, hashed = queue.spark, lambda df: df.repartition(queue.buckets, "url")
    blank = {name: F.lit(None).cast(_QUEUE[name]) for name in ("parent_url", "rank", "outcome", "links")}
    stored = spark.createDataFrame([], "url string") if seen_urls is None else seen_urls.select("url").distinct()
    queue.append(hashed(stored).withColumns({"depth": F.lit(-1), **blank}))
    seed = spark.range(1).select(normalize_url(F.lit(start_url)).alias("url"))
    level = seed.where(url_rule(prefix, regex).isNull() & F.col("url").isNotNull())
    level = hashed(level).join(queue.read().select("url"), "url", "left_anti")
    level = level.select("url", blank["parent_url"].alias("parent_url"), F.array().cast("array<bigint>").alias("rank"))
    budget = None if max_pages is None else max_pages - existing_on_domain

    for depth in range(max_depth + 1):
        if budget is not None and budget <= 0:
            return F.col("depth").between(0, depth - 1)
        counts = Observation(f"level-{depth}")
        rows = visit(level, depth).withColumn("depth", F.lit(depth))
        queue.append(rows.observe(counts, F.count(F.lit(1)).alias("all"), F.count_if(F.col("outcome") == "saved").alias("saved")))
        size = counts.get
        if size["all"] == 0:
            break
        if budget is not None and size["saved"] >= budget:
            # The budget ends in this level: tasks after its last page stay unfetched.
            saved = queue.read().where((F.col("depth") == depth) & (F.col("outcome") == "saved")).select("rank")
            last = global_rank(saved, "rank", name="nth").where(F.col("nth") == budget - 1).first()["rank"]
            end = F.array(*[F.lit(place).cast("bigint") for place in last]) if last else F.array().cast("array<bigint>")
            return F.col("depth").between(0, depth - 1) | ((F.col("depth") == depth) & (F.col("rank") <= end))
        if budget is not None:
            budget -= size["saved"]
        if depth < max_depth:
            level = next_level(queue.read(), depth, prefix, regex)
            if (depth + 1) % _LONGEST_RANK == 0:
                level = hashed(global_rank(level, "rank", name="nth").withColumn("rank", F.array("nth")).drop("nth"))
    return F.col("depth") >= 0
