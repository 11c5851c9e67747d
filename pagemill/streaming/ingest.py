"""Incremental ingest: a stream of pages into a keyed document store.

A store is a folder of Parquet files, bucketed and sorted by the hash of the document
id. Each micro-batch appends its own documents, one file per bucket, so its cost does
not grow with the store, and several streams may feed one store. Rows carry the fetch
time and page they come from, and the latest fetch per id wins: a replayed batch adds
rows that change nothing. Readers merge a bucket inside one task, without an exchange,
however many batches there are; compaction does the same and writes the buckets anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from pagemill.operators.bucketed import BucketedTable
from pagemill.operators.sizing import cut_lineage
from pagemill.operators.upsert import last_by_key
from pagemill.plans.documents import build_documents
from pagemill.schema import DOCUMENT_SCHEMA
from pagemill.sources.files import path_exists, publish, read_text
from pagemill.streaming.sums import changes, write_sums

STORE_SCHEMA = T.StructType(
    [
        *DOCUMENT_SCHEMA.fields,
        T.StructField("version_at", T.TimestampType()),
        T.StructField("version_page", T.LongType()),
        T.StructField("run", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _newest(rows: DataFrame) -> DataFrame:
    """The latest fetch of each document; of one moment, the highest page id."""
    return last_by_key(rows.withColumn("version", F.struct("version_at", "version_page")))


def _buckets(spark: SparkSession, store: str, wanted: int | None) -> int:
    """The store's number of buckets; whoever comes first fixes it, by default to that of shuffle partitions."""
    layout = f"{store.rstrip('/')}/_buckets"
    if not path_exists(spark, layout):
        publish(spark, layout, str(wanted or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return int(read_text(spark, layout))


def _table(spark: SparkSession, store: str, wanted: int | None = None) -> BucketedTable:
    return BucketedTable.open(spark, store, {f.name: f.dataType.simpleString() for f in STORE_SCHEMA.fields}, "doc_id", _buckets(spark, store, wanted))


def write_batch(pages: DataFrame, store: str, run: str, batch_id: int, buckets: int | None = None, sums: bool = False, **build) -> None:
    """Documents of one batch of pages; writing it again changes nothing that readers see."""
    kept = pages.withColumns({"version_at": F.col("fetched_at"), "version_page": F.col("page_id").cast("bigint")})
    rows = build_documents(kept, keep=("version_at", "version_page"), **build)
    rows = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch_id).cast("bigint")}).select(*STORE_SCHEMA.names)
    table = _table(pages.sparkSession, store, buckets)
    # Hashed as the buckets are: one file each.
    rows = _newest(rows.repartition(table.buckets, "doc_id"))
    if sums:
        rows = cut_lineage(rows)
        versioned = lambda df: df.withColumn("version", F.struct("version_at", "version_page"))
        others = table.read().where((F.col("run") != run) | (F.col("batch") != batch_id))
        write_sums(changes(versioned(rows), versioned(_newest(others))), store, run, batch_id)
        rows = rows.repartition(table.buckets, "doc_id")
    table.append(rows)


def ingest_stream(
    pages: DataFrame, store: str, checkpoint: str, buckets: int | None = None, sums: bool = False, **build
) -> DataStreamWriter:
    """Writer that upserts a stream of ``(page_id, url, html, fetched_at)`` rows.

    Rows are windowed per page, which streams do not allow, hence ``foreachBatch``.
    The run is the query's id, which its checkpoint keeps over restarts. With ``sums``
    the store's report is kept up to date (:mod:`pagemill.streaming.sums`), at the price of
    one scan of the stored rows' few counted columns per batch. ``build`` goes to
    :func:`pagemill.plans.documents.build_documents`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("the streaming query gives its batches no id")
        write_batch(batch, store, run, batch_id, buckets, sums, **build)

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def _stored(spark: SparkSession, store: str) -> DataFrame:
    if not path_exists(spark, f"{store.rstrip('/')}/_buckets"):
        return spark.createDataFrame([], STORE_SCHEMA)
    return _table(spark, store).read()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Current documents of a store; empty when nothing was written yet."""
    return _newest(_stored(spark, store)).select(*DOCUMENT_SCHEMA.names)


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Merge all batches into one file per bucket of a new store, without its report; streams may go on with that store."""
    _table(spark, target, _buckets(spark, store, None)).append(_newest(_stored(spark, store)))
