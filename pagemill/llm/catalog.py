"""The training-data queries: name -> callable(spark, folder of the given tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (
    collocations, conversation_trie, embedding_dedup, exact_dedup, jaccard, language_id, licenses, mixing, neighbours, packing, quality, secrets, toxicity,
)
from pagemill.llm.common import id_remainder, partitions, shared_path, table

#: Shares of the domains (languages) wanted in the mix, at as many tokens as there are.
TARGETS = mixing.Targets({"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2})
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf, "documents"))


def op2_target_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, docs.select("text", F.col("lang").alias("domain")), TARGETS)


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.link_components(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"), licenses.known_licenses(spark))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    model = toxicity.train(docs, labels.filter(id_remainder(F.col("doc_id"), 3) != 1))
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages")


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    index = exact_dedup.DigestIndex.open(spark, shared_path(spark, "digest-index"), partitions(spark))
    found = exact_dedup.deduplicate(table(spark, sf, "documents"), index)
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


def op10_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf, "embeddings"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie.trie_nodes(table(spark, sf, "conversations"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_secret_scan, op2_target_mixing, op3_quality_classifier, op4_language_id, op5_jaccard_join, op6_license_scan, op7_toxicity, op8_exact_dedup, op9_packing,
        op10_nearest_neighbours, op11_embedding_dedup, op12_collocations, op13_conversation_trie,
    )
    return {f.__name__: f for f in operators}


def llm_sql() -> dict[str, str]:
    return {
        "op6_license_scan": licenses.sql(), "op8_exact_dedup": exact_dedup.SQL, "op11_embedding_dedup": embedding_dedup.SQL, "op12_collocations": collocations.SQL,
        "op13_conversation_trie": conversation_trie.SQL,
    }
