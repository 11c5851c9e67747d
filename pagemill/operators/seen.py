"""URLs seen over many runs: a stored index, and a filter that spares most look-ups in it.

The index is bucketed by URL, so candidates are exchanged and it is not. Beside it lie
the words of a Bloom filter with two bits per URL. A candidate that the filter does not
know is new; only those that it may know are exchanged and meet the index, whose answer
counts. So a false positive costs a look-up and never a URL.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.bucketed import BucketedTable
from pagemill.sources.files import names_in, path_exists, publish, read_text

_URLS = {"url": "string"}
_PROBES = 2
#: Bits of the largest filter: its words are broadcast, 16 MB at most.
MOST_BITS = 1 << 26


def _bits(url: Column, size: int) -> list[Column]:
    """The positions of a URL among ``size`` bits."""
    return [F.pmod(F.xxhash64(F.lit(k), url), F.lit(size)) for k in range(_PROBES)]


@dataclass(frozen=True)
class SeenIndex:
    """Seen URLs at ``path``: ``urls/`` (bucketed), ``filter/<part>/`` (words of the filter), ``_layout`` (buckets, bits)."""

    spark: SparkSession
    path: str
    table: BucketedTable
    size: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None, expected: int = 1 << 20) -> SeenIndex:
        """The index at ``path``; the first to open it fixes buckets and bits, 16 per expected URL. More URLs only make the filter less sharp."""
        path = path.rstrip("/")
        if not path_exists(spark, f"{path}/_layout"):
            publish(spark, f"{path}/_layout", f"{buckets or int(spark.conf.get('spark.sql.shuffle.partitions'))} {min(MOST_BITS, 64 * max(1, expected // 4))}")
        found, size = map(int, read_text(spark, f"{path}/_layout").split())
        return cls(spark, path, BucketedTable.open(spark, f"{path}/urls", _URLS, "url", found), size)

    def words(self) -> DataFrame:
        """``(place, word)`` of the filter, 64 bits each; absent words are zero."""
        parts = [f"{self.path}/filter/{name}" for name in names_in(self.spark, f"{self.path}/filter")]
        schema = "place bigint, word bigint"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts).groupBy("place").agg(F.bit_or("word").alias("word"))

    def add(self, urls: DataFrame) -> None:
        """Add the URLs of ``urls`` that are not there yet. The filter's words go first, so that it never knows too little."""
        new = self.unseen(urls.select("url").where(F.col("url").isNotNull()).distinct())
        spots = new.select(F.explode(F.array(*_bits(F.col("url"), self.size))).alias("bit"))
        word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))
        words = spots.select(F.floor(F.col("bit") / 64).alias("place"), word.alias("word")).groupBy("place").agg(F.bit_or("word").alias("word"))
        words.write.parquet(f"{self.path}/filter/{uuid.uuid4().hex}")
        self.table.append(new.repartition(self.table.buckets, "url"))

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """The rows of ``candidates`` (any columns besides ``url``) whose URL is not in the index; a null URL is not."""
        words, known = self.words(), F.lit(True)
        probed = candidates
        for k, bit in enumerate(_bits(F.col("url"), self.size)):
            own = words.select(F.col("place").alias(f"_place{k}"), F.col("word").alias(f"_word{k}"))
            probed = probed.withColumns({f"_bit{k}": F.pmod(bit, F.lit(64)).cast("int"), f"_place{k}": F.floor(bit / 64)}).join(F.broadcast(own), f"_place{k}", "left")
            known = known & (F.getbit(F.coalesce(f"_word{k}", F.lit(0).cast("bigint")), F.col(f"_bit{k}")) == 1)
        probed = probed.withColumn("_known", known).select(*candidates.columns, "_known")
        maybe = probed.where("_known").select(*candidates.columns)
        return probed.where("NOT _known").select(*candidates.columns).unionByName(maybe.join(self.table.read(), "url", "left_anti").select(*candidates.columns))

    def close(self) -> None:
        """Forget the catalogue's entry; the index stays where it is."""
        self.table.drop()
