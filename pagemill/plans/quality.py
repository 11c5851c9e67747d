"""Contract checks on documents and the quality score of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.plans.contract import compile_rules, document_contract

def contract_violations(documents: DataFrame, schema: dict | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, rule)`` for every broken rule of a JSON schema, by default that of documents.

    Columns that the schema does not name break ``additionalProperties`` if it allows none.
    """
    schema = document_contract() if schema is None else schema
    rules = compile_rules(schema)
    if schema.get("additionalProperties") is False:
        for name in documents.columns:
            if name not in schema.get("properties", {}) and name != key:
                rules[f"{name}.additionalProperties"] = F.col(name).isNotNull()
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return documents.select(key, F.explode(broken).alias("rule"))


def extraction_score(title: Column, body: Column, meta: Column, html_length: Column) -> Column:
    """0 to 1: text length, text share of the HTML, title and metadata, to 3 places."""
    # The weights and the sizes that earn them in full.
    chars = F.length(body).cast("double")
    length = F.least(chars / 500, F.lit(1.0)) * 0.4
    share = F.when(html_length > 0, F.least(chars / html_length / 0.3, F.lit(1.0)) * 0.3).otherwise(0.0)
    titled = F.when(title != "", 0.15).otherwise(0.0)
    rich = F.least(F.size(meta) / F.lit(3.0), F.lit(1.0)) * 0.15
    return F.bround(length + share + titled + rich, 3)


def best_extraction(parsed: dict[str, DataFrame], key: str = "page_id") -> DataFrame:
    """Per page the highest-scoring of several extractions; ties go to the first name."""
    together = None
    for name, rows in sorted(parsed.items()):
        named = rows.select(key, F.lit(name).alias("extractor"), "title", "body_text", "meta", "html_length")
        together = named if together is None else together.unionByName(named)
    return best_rows(together, key)


def best_rows(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """As :func:`best_extraction`, from rows that name their extractor; rows hashed by page stay where they are."""
    fields = ("extractor", "score", "title", "body_text")
    score = extraction_score(F.col("title"), F.col("body_text"), F.col("meta"), F.col("html_length"))
    better = F.struct((-F.col("score")).alias("lost"), "extractor")
    return (
        extracted.withColumn("score", score)
        .groupBy(key)
        .agg(F.min_by(F.struct(*fields), better).alias("best"))
        .select(key, *[F.col(f"best.{name}").alias(name) for name in fields])
    )
