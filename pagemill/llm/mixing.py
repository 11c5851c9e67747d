"""Mixing to target weights by soft membership, with DataFrame operations only.

A labelled table teaches a naive Bayes classifier over hashed words, which gives each
document a posterior over the domains of ``targets``. Non-negative rates are then
fitted so that the expected tokens of each domain, the sum over documents of rate times
tokens times posterior, match the targets in the least-squares sense, each domain
relative to what it holds. Projected gradient does it: an iteration is one
aggregation to one row, and a document's new rate is the old one less the posterior-
weighted errors, but not below zero.

Defined results: null texts are empty, have no tokens, the prior as posterior and the
starting rate. Rows that share a doc_id are one document, whose tokens add up. Labelled
rows without text or with a domain that has no target teach nothing; a domain never
seen has a posterior near zero. Targets are scaled to a sum of 1 (at least one must be
positive). A null doc_id is one document. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_sample, settle


@dataclass(frozen=True)
class Targets:
    """Weights of domains and the tokens wanted per token at hand."""

    weights: dict[str, float]
    budget: float = 1.0

    def __post_init__(self) -> None:
        if not self.weights or min(self.weights.values()) < 0 or sum(self.weights.values()) <= 0:
            raise ValueError("targets need non-negative weights, one of them positive")


def _words(docs: DataFrame, *keep: str, buckets: int) -> DataFrame:
    """One row per word: its bucket, and -1 for the empty string."""
    text = F.lower(F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\r\n", "   "))
    words = docs.select(*keep, F.explode(F.split(text, " ")).alias("word"))
    bucket = F.when(F.col("word") == "", -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(buckets)))
    return words.select(*keep, bucket.cast("int").alias("bucket"))


def train(labelled: DataFrame, targets: Targets, rows: int = 20_000, buckets: int = 4096) -> DataFrame:
    """Log weights per bucket, a column ``w<k>`` per domain in order of name; bucket -1 has the priors.

    Learns from the ``rows`` different labelled texts that hash lowest. The result has ``buckets`` + 1 rows.
    """
    names = sorted(targets.weights)
    known = labelled.select("text", F.col("domain").cast("string").alias("domain")).filter(F.col("domain").isin(names) & F.col("text").isNotNull())
    known = known.withColumn("_h", F.xxhash64("text", "domain"))
    last = bounded_sample(known.select("_h").distinct(), "_h", rows).agg(F.max(F.xxhash64("_h"))).first()[0]
    sample = known.filter(F.xxhash64("_h") <= F.lit(last)).dropDuplicates(["_h"]).drop("_h")
    sums = [F.coalesce(F.sum(F.when(F.col("domain") == n, 1)), F.lit(0)).alias(f"c{k}") for k, n in enumerate(names)]
    sample = settle(sample, "labelled")  # bounded: ``rows`` texts
    counts = _words(sample, "domain", buckets=buckets).filter("bucket >= 0").groupBy("bucket").agg(*sums)
    docs = sample.agg(*sums).first()
    spark = labelled.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    totals = every.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(names))]).first()
    smooth = 0.1
    logs = [F.log((F.col(f"c{k}") + smooth) / (totals[f"c{k}"] + smooth * buckets)).alias(f"w{k}") for k in range(len(names))]
    seen = sum(docs[f"c{k}"] for k in range(len(names)))
    prior = [(-1, *(math.log((docs[f"c{k}"] + smooth) / (seen + smooth * len(names))) for k in range(len(names))))]
    schema = "bucket int, " + ", ".join(f"w{k} double" for k in range(len(names)))
    return settle(every.select("bucket", *logs).unionByName(spark.createDataFrame(prior, schema)).coalesce(1), "weights")


def posteriors(docs: DataFrame, weights: DataFrame, targets: Targets, sharpness: float = 30.0) -> DataFrame:
    """doc_id, n_tokens, ``p_<domain>``: one row per document.

    The evidence of a text counts as that of at most ``sharpness`` words, so that memberships stay soft.
    """
    names = sorted(targets.weights)
    prior = weights.filter("bucket = -1").first()
    table = F.broadcast(weights.filter("bucket >= 0"))  # a fixed number of buckets
    words = _words(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", buckets=weights.count() - 1)
    sums = words.join(table, "bucket", "left").groupBy("doc_id").agg(
        F.count(F.when(F.col("bucket") >= 0, 1)).alias("n_tokens"),
        *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))],
    )
    soften = F.least(F.lit(1.0), F.lit(sharpness) / F.greatest(F.col("n_tokens"), F.lit(1)))
    logit = [F.col(f"s{k}") * soften + F.lit(prior[f"w{k}"]) for k in range(len(names))]
    sums = sums.select("doc_id", "n_tokens", *[x.alias(f"l{k}") for k, x in enumerate(logit)])
    most = F.greatest(*[F.col(f"l{k}") for k in range(len(names))]) if len(names) > 1 else F.col("l0")
    sums = sums.select("doc_id", "n_tokens", *[F.exp(F.col(f"l{k}") - most).alias(f"e{k}") for k in range(len(names))])
    whole = reduce(Column.__add__, [F.col(f"e{k}") for k in range(len(names))])
    return sums.select("doc_id", "n_tokens", *[(F.col(f"e{k}") / whole).alias(f"p_{n}") for k, n in enumerate(names)])


def fit_rates(members: DataFrame, targets: Targets, iterations: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """``members`` (settled posteriors) with a column ``rate``."""
    names = sorted(targets.weights)
    p = [F.col(f"`p_{n}`") for n in names]
    held = members.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * x).alias(f"t{k}") for k, x in enumerate(p)]).first()
    total = held["all"] or 0
    rates = members.withColumn("rate", F.lit(float(targets.budget)))
    if not total:
        return rates
    share = sum(targets.weights.values())
    wanted = [targets.weights[n] / share * targets.budget * total for n in names]
    for turn in range(iterations):
        got = rates.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * x).alias(f"t{k}") for k, x in enumerate(p)]).first()
        errors = [got[f"t{k}"] - wanted[k] for k in range(len(names))]
        if max(map(abs, errors)) <= tolerance * targets.budget * total:
            break
        pull = reduce(Column.__add__, [x * F.lit(e / max(held[f"t{k}"], 1e-9 * total)) for k, (x, e) in enumerate(zip(p, errors, strict=True))])
        rates = rates.withColumn("rate", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(0.0), F.col("rate") - pull)).otherwise(F.col("rate")))
        if turn % 8 == 7:
            rates = settle(rates, "rates")
    return rates


def mix(docs: DataFrame, labelled: DataFrame, targets: Targets, rows: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, ``p_<domain>`` and rate: one row per document."""
    members = settle(posteriors(docs, train(labelled, targets, rows), targets), "members")
    return fit_rates(members, targets)


def apply_rates(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """Each row of ``docs`` as often as its rate says: the whole part, and once more with the chance of the rest.

    The draw is a hash of the id, so a repeated run gives the same rows.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1_000_000)) / 1_000_000
    times = rates.select(F.col("doc_id").alias("_id"), F.floor(F.col("rate") + draw).cast("int").alias("_times"))
    joined = docs.join(times, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))).filter("_times > 0")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*docs.columns)
