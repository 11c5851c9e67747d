"""The training-data pipeline: documents to packed sequences in five stages.

Each stage takes what the one before kept (written as Parquet and read again) and the
folder of the given tables. All but the last return the columns of ``documents``.

1. quality: pages that the co-trained classifier rejects go.
2. exact_dedup: of equal texts the largest doc_id stays.
3. jaccard_join: of documents linked by shingle similarity the least doc_id stays.
4. mixing: documents occur as often as their fitted rates say, so that languages have
   the target shares of the tokens at hand.
5. packing: token pieces placed in sequences of 2048.

There is no SQL for it, as two stages are trained and one draws; the tests compare it
with brute-force versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, jaccard, mixing, packing, quality
from pagemill.llm.catalog import TARGETS, TOKENIZER
from pagemill.llm.common import partitions, settle, shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex.open(spark, shared_path(spark, "digest-index"), partitions(spark))
    kept = exact_dedup.drop_copies(docs, index)
    index.close()
    return kept


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_linked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rates = mixing.mix(docs, docs.select("text", F.col("lang").alias("domain")), TARGETS)
    return mixing.apply_rates(docs, rates)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("target_mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
