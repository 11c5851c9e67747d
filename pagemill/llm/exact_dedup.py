"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the text. A
batch is reduced to one row per digest inside its tasks, meets the index in a
sort-merge anti-join (the index side is read by bucket, without an exchange), and
what is new is appended. A row's fate is then looked up by digest; that join
exchanges both sides, so that Spark can split the partition of a hot text.

Defined results: a null text counts as empty. Of equal texts the largest doc_id
stays, or the id the index already holds for that text. Rows that repeat both
doc_id and text are one document: one row, counted each time in ``group_size``. A
null doc_id loses against any other; alone, it stays. An empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import settle


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table at ``path``; the name only lives in this session's catalogue."""

    spark: SparkSession
    path: str
    buckets: int
    name: str

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """The index at ``path``; an empty one if there is none. ``buckets`` must stay what it was."""
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, path, buckets, name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the index out of the catalogue; its files stay, and results already made do not need it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, rows: DataFrame) -> None:
        """Add digests that are not in the index yet."""
        self.spark.catalog.refreshTable(self.name)
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32 bytes of its text's SHA-256."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per document. Appends new texts to the index."""
    rows = settle(text_digests(docs), "digests")
    batch = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    batch = settle(batch, "batch")
    index.append(batch.join(index.read().hint("merge"), "digest", "left_anti"))
    owners = index.read().withColumnRenamed("keep_id", "owner_id")
    groups = settle(batch.join(owners.hint("merge"), "digest").select("digest", "group_size", "owner_id"), "groups")
    members = rows.groupBy("doc_id", "digest").agg(F.lit(True).alias("_row"))
    return members.join(groups, "digest").select(
        "doc_id",
        F.col("owner_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("owner_id")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with their columns. The one exchange of the texts serves the join and repeated rows."""
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))  # for a null id
    stay = deduplicate(docs, index).filter("kept").select(name.alias("_name"), F.col("digest").alias("_digest"))
    text = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    found = docs.withColumns({"_name": name, "_digest": text}).join(stay, ["_name", "_digest"])
    return found.dropDuplicates(["_name", "_digest"]).select(*docs.columns)


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""
