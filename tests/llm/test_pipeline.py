"""The pipeline, stage by stage, against plain versions on a small corpus."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_jaccard import plain_components

import corpus_pipeline
from pagemill.llm import mixing, quality
from pagemill.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dice = random.Random(4)
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, kept = [], [], []
    for i in range(300):
        kind = dice.random()
        if kind < 0.25 or i < 20:
            text = " ".join(f"{dice.choice('ABCDEF') * 4}$$#" for _ in range(60))
        elif kind < 0.4:
            text = dice.choice(kept)
        elif kind < 0.55:
            words = dice.choice(kept).split()
            words[dice.randrange(len(words))] = f"changed{i}"
            text = " ".join(words)
        else:
            text = " ".join(dice.choices([f"word{k}" for k in range(300)], k=dice.randrange(60, 200)))
        bad = "$$#" in text
        if not bad:
            kept.append(text)
        rows.append((i, text, ("en", "de", "fr", "es")[i % 4], f"s{i % 3}", len(text), "more"))
        labels.append((i, int(not bad), 0))
    rows += [(400, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "target_mixing", "packing"]


def test_each_stage_and_the_whole(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality_classifier"](spark, docs, folder).cache()
    assert good.columns == columns
    plain = {r.doc_id for r in docs.collect() if r.text and "$$#" not in r.text}
    assert {r.doc_id for r in good.collect()} - {400} == plain
    model = quality.train(docs, table(spark, folder, "labels"))
    assert {r.doc_id for r in quality.score(docs, model).filter("keep").collect()} == {r.doc_id for r in good.collect()}

    single = steps["exact_dedup"](spark, good, folder).cache()
    last = {}
    for r in good.collect():
        key = hashlib.sha256((r.text or "").encode()).digest()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(last.values())

    apart = steps["jaccard_join"](spark, single, folder).cache()
    want = plain_components([(r.doc_id, r.text) for r in single.collect()])
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(set(want.values()))

    mixed = steps["target_mixing"](spark, apart, folder).cache()
    rates = mixing.mix(apart, apart.select("text", F.col("lang").alias("domain")), corpus_pipeline.TARGETS).collect()
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and all(int(r.rate) <= n.get(r.doc_id, 0) <= int(r.rate) + 1 for r in rates)

    packed = steps["packing"](spark, mixed, folder)
    assert {r.doc_id for r in packed.collect()} == set(n)

    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == packed.columns
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(whole) == total(packed)
