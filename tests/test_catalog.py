"""Catalogued queries against their SQL in DuckDB.

A selection runs by default; set CATALOG_ALL=1 for every query.
"""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from pagemill.catalog import inputs
from pagemill.catalog.oracle import all_sql
from pagemill.catalog.queries import all_queries

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
QUICK = ("url_normalize", "url_resolve", "page_tokens", "page_text_variants", "links_cleaned", "url_reject_reasons", "fetch_outcomes",
         "doc_content_type", "lang_predict", "collection_load", "contract_violations", "collection_upsert", "report_long")


def names():
    return sorted(all_queries()) if os.environ.get("CATALOG_ALL") else QUICK


@pytest.fixture(scope="module")
def sql_engine():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no tables at {FOLDER}")
    engine = duckdb.connect()
    for table in ("pages", "documents"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return engine


def test_the_whole_crawl_replaces_stored_documents(spark, sql_engine):
    test_same_rows(spark, sql_engine, "crawl_job_whole")
    stored = inputs.visited_collection(spark, FOLDER).select("url", "title").distinct()
    after = queries()["crawl_job_whole"](spark, FOLDER).select("url", F.col("title").alias("new"))
    both = stored.join(after, "url")
    assert both.select("url").distinct().count() == stored.select("url").distinct().count()
    assert 0 < both.where("new <> title").count() < both.count()
    assert after.count() > stored.select("url").distinct().count()


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, sql_engine, name):
    df = queries()[name](spark, FOLDER)
    result = sql_engine.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(str([row[columns.index(c)] for c in order]) for row in result.fetchall())
    got = sorted(str([row[c] for c in order]) for row in df.collect())
    assert got == want
