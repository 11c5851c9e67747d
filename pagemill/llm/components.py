"""Connected components by alternating stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with v < u.

    Large: every node hangs its larger neighbours on its least neighbour (or itself).
    Small: every node hangs its smaller neighbours, and itself, on the least of them.
    A node's least neighbour is summed up before any shuffle, and written, so that the
    join back has plain exchanges on both sides, in which Spark splits hot nodes.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        least = settle(least, "least")
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = settle(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        out = out.select("x.u", "x.v")
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that occurs in links (u, v); ids are not null.

    Loops and repeated or reversed links do no harm. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    now = settle(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    before = now.agg(*mark).first()
    while before["n"]:
        now = settle(_star(_star(now, True), False), "links")
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
