"""Link expansion against a plain queue, and the streaming ingest."""

import datetime as dt
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagemill.config import CrawlConfig
from pagemill.operators.bucketed import BucketedTable
from pagemill.operators.frontier import expand_links, known_graph, next_level
from pagemill.operators import frontier
from pagemill.operators.seen import SeenIndex
from pagemill.operators.sizing import global_rank
from pagemill.plans import documents
from pagemill.plans.documents import build_documents, run_expansion
from pagemill.sources.collection import load_documents
from pagemill.streaming.ingest import compact, ingest_stream, read_store

HOST = "http://h.com"


def queue_walk(graph, outcome, seed, max_depth, max_pages, seen=(), on_domain=0):
    """The same walk with a queue in memory."""
    seen, queue, done, saved = set(seen), deque(), [], on_domain
    if seed not in seen:
        seen.add(seed)
        queue.append((seed, 0, None))
    while queue and (max_pages is None or saved < max_pages):
        url, depth, parent = queue.popleft()
        state = outcome.get(url, "failed")
        done.append((url, depth, parent, state))
        saved += state == "saved"
        if state == "saved" and depth < max_depth:
            for link in graph[url]:
                if link not in seen:
                    seen.add(link)
                    if not link.endswith(".pdf"):
                        queue.append((link, depth + 1, url))
    return done


@pytest.fixture(scope="module")
def site():
    rng = random.Random(7)
    urls = [f"{HOST}/{i}" for i in range(60)] + [f"{HOST}/x{i}.pdf" for i in range(4)]
    graph = {u: [HOST + "/0", *rng.sample(urls, rng.randint(0, 7))] for u in urls}
    graph = {u: list(dict.fromkeys(links)) for u, links in graph.items()}
    outcome = {u: rng.choice(["saved", "saved", "saved", "empty"]) for u in urls if rng.random() < 0.9}
    outcome[f"{HOST}/0"] = "saved"
    return graph, outcome


CASES = [(0, None, 0), (3, None, 0), (3, 4, 0), (3, 17, 0), (3, 10, 6)]


@pytest.mark.parametrize("depth, pages, stored", CASES)
def test_walk_equals_queue(spark, site, depth, pages, stored):
    graph, outcome = site
    outcomes = spark.createDataFrame(list(outcome.items()), "url string, outcome string")
    links = spark.createDataFrame([(u, i, t) for u, ts in graph.items() for i, t in enumerate(ts)], "url string, rank int, link string")
    known = [f"{HOST}/{i}" for i in range(40, 40 + stored)]
    existing = spark.createDataFrame([(u,) for u in known], "url string")
    walk = expand_links(
        HOST + "/0", outcomes, links, depth, pages, existing, stored)
    got = [(r.url, r.depth, r.parent_url, r.outcome) for r in walk.tasks.orderBy("depth", "rank").collect()]
    want = queue_walk(graph, outcome, HOST + "/0", depth, pages, known, stored)
    assert got == want
    counts = walk.counters().first()
    assert (counts.fetched, counts.saved, counts.failed) == (
        len(want), sum(w[3] == "saved" for w in want), sum(w[3] == "failed" for w in want))


def test_stored_seed_stops_the_walk_unless_refreshed(spark, site):
    graph, outcome = site
    outcomes = spark.createDataFrame(list(outcome.items()), "url string, outcome string")
    links = spark.createDataFrame([(f"{HOST}/0", 0, f"{HOST}/1")], "url string, rank int, link string")
    seed = spark.createDataFrame([(f"{HOST}/0",)], "url string")
    assert expand_links(HOST + "/0", outcomes, links, 2, 5, seed).tasks.count() == 0
    assert expand_links(HOST + "/0", outcomes, links, 2, 5, seed, refresh=True).tasks.count() == 2


def test_a_level_exchanges_its_frontier_only(spark, site, tmp_path):
    graph, outcome = site
    known = known_graph(
        spark.createDataFrame(list(outcome.items()), "url string, outcome string"),
        spark.createDataFrame([(u, i, t) for u, ts in graph.items() for i, t in enumerate(ts)], "url string, rank int, link string"))
    queue = BucketedTable.open(spark, str(tmp_path / "queue"), frontier._QUEUE, "url", known.buckets)
    seed = spark.createDataFrame([(HOST + "/0",)], "url string").withColumns({"parent_url": F.lit(None).cast("string"), "rank": F.array().cast("array<bigint>")})
    queue.append(seed.repartition(known.buckets, "url").join(known.read(), "url", "left").withColumn("depth", F.lit(0)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        level = next_level(queue.read(), 0).join(known.read(), "url", "left")
        plan = level._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(url") == plan.count("Exchange") == 1
    assert {r.url for r in level.collect()} == {t for t in graph[HOST + "/0"] if not t.endswith(".pdf")} - {HOST + "/0"}
    for table in (known, queue):
        table.drop()


def test_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(frontier, "_LONGEST_RANK", 2)
    urls = [f"{HOST}/{i}" for i in range(9)]
    graph = {u: [urls[min(i + 2, 8)], urls[min(i + 1, 8)]] for i, u in enumerate(urls)}
    outcomes = spark.createDataFrame([(u, "saved") for u in urls], "url string, outcome string")
    links = spark.createDataFrame([(u, i, t) for u, ts in graph.items() for i, t in enumerate(ts)], "url string, rank int, link string")
    for pages in (None, 6):
        walk = expand_links(urls[0], outcomes, links, 20, pages)
        got = [(r.url, r.depth, r.parent_url, r.outcome) for r in walk.tasks.orderBy("depth", "rank").collect()]
        assert got == queue_walk(graph, dict.fromkeys(urls, "saved"), urls[0], 20, pages)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(5)
    assert all(r.v == r["rank"] for r in global_rank(df, "v").collect())
    assert global_rank(df.where("false"), "v").count() == 0


def page(text, *links):
    anchors = "".join(f"<a href='{link}'>{link}</a>" for link in links)
    return f"<html><head><title>{text} | Site</title></head><body><main><h1>{text}</h1>{anchors}</main></body></html>"


def test_run_expansion(spark, tmp_path):
    at = dt.datetime(2026, 6, 1)
    rows = [
        (1, "http://h.com/", "http://h.com/", 200, "text/html", None, page("Home", "/a", "/b", "/gone", "/f.pdf", "http://o.com/")),
        (2, "http://h.com/a", "http://h.com/a2?ref=1", 200, "text/html", None, page("A", "/c")),
        (3, "http://h.com/b", "http://h.com/b", 500, "text/html", None, page("B", "/d")),
        (4, "http://h.com/c", "http://h.com/a2", 200, "text/html", None, page("C")),
        (5, "http://o.com/", "http://o.com/", 200, "text/html", None, page("Other")),
    ]
    log = spark.createDataFrame(
        [(*r, None, at) for r in rows],
        "page_id long, url string, final_url string, status_code int, content_type string, content_length long, html string, error string, fetched_at timestamp")
    config = CrawlConfig("http://H.com", str(tmp_path / "out"), max_pages=10, max_depth=2)
    walk, _ = run_expansion(config, log)
    assert tuple(walk.counters().first()) == (5, 2, 3)
    docs = {r.url: r.title for r in load_documents(spark, config.output_path).collect()}
    assert docs == {"http://h.com/": "Home", "http://h.com/a2": "C"}
    # A second run finds its seed stored and changes nothing.
    again, _ = run_expansion(config, log)
    assert again.tasks.count() == 0
    assert {r.url: r.title for r in load_documents(spark, config.output_path).collect()} == docs


def test_only_reached_pages_are_parsed(spark, tmp_path, monkeypatch):
    """A site of 40 pages in a chain of two links each, of which a budget of five reaches a few."""
    rows = [(i, f"http://h.com/{i}", 200, "text/html", page(f"P{i}", f"/{2 * i + 1}", f"/{2 * i + 2}"), dt.datetime(2026, 6, 1)) for i in range(40)]
    log = spark.createDataFrame(
        [(i, u, u, status, kind, None, html, None, at) for i, u, status, kind, html, at in rows],
        "page_id long, url string, final_url string, status_code int, content_type string, content_length long, html string, error string, fetched_at timestamp")
    parsed, parse = [], documents.parse_pages
    monkeypatch.setattr(documents, "parse_pages", lambda pages, *args, **how: (parsed.append(pages.count()), parse(pages, *args, **how))[1])
    config = CrawlConfig("http://h.com/0", str(tmp_path / "out"), max_pages=5, max_depth=9)
    walk, docs = run_expansion(config, log)
    assert parsed == [1, 2, 4]
    assert sorted(r.title for r in docs.collect()) == ["P0", "P1", "P2", "P3", "P4"]
    assert tuple(walk.counters().first()) == (5, 0, 5)


def test_the_latest_fetch_that_succeeded_counts(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 6, n)
    rows = [
        (1, "http://h.com/", 200, page("Home old", "/a"), None, day(1)), (2, "http://h.com/", 200, page("Home", "/a", "/b"), None, day(2)),
        (3, "http://h.com/", 500, None, None, day(3)), (4, "http://h.com/a", 0, None, "request timed out", day(1)),
        (5, "http://h.com/a?ref=x", 200, page("A"), None, day(2)), (6, "http://h.com/b", 404, None, None, day(1)), (7, "http://h.com/b", 500, None, None, day(2)),
    ]
    log = spark.createDataFrame(
        [(i, u, u, status, "text/html" if status else None, None, html, error, at) for i, u, status, html, error, at in rows],
        "page_id long, url string, final_url string, status_code int, content_type string, content_length long, html string, error string, fetched_at timestamp")
    config = CrawlConfig("http://h.com", str(tmp_path / "out"), max_pages=10, max_depth=2)
    walk, docs = run_expansion(config, log)
    assert {r.url: r.title for r in docs.collect()} == {"http://h.com/": "Home", "http://h.com/a": "A"}
    assert tuple(walk.counters().first()) == (3, 1, 2)


def test_streams_share_a_store(spark, tmp_path):
    """Two queries with batch ids of their own, a replay of the first one, and a compacted store that goes on."""
    at, schema = dt.datetime(2026, 6, 1), "page_id long, url string, html string, fetched_at timestamp"
    parts = {
        "one": [(1, "http://h.com/a", page("A one"), at), (2, "http://h.com/b", page("B"), at)],
        "two": [(3, "http://h.com/a", page("A two"), at + dt.timedelta(days=1)), (4, "http://h.com/c", page("C"), at)],
    }
    store = str(tmp_path / "store")

    def feed(name, progress, store):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        ingest_stream(stream, store, str(tmp_path / progress), link_scope="raw").trigger(availableNow=True).start().awaitTermination()
        return {r.url[-1]: r.title for r in read_store(spark, store).collect()}

    for name, rows in parts.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    assert feed("one", "p1", store) == {"a": "A one", "b": "B"}
    both = {"a": "A two", "b": "B", "c": "C"}
    assert feed("two", "p2", store) == both
    assert feed("one", "p3", store) == both
    # Stored rows are merged where they lie.
    assert "Exchange" not in read_store(spark, store)._jdf.queryExecution().executedPlan().toString()
    small = str(tmp_path / "small")
    compact(spark, store, small)
    files = [name for name in os.listdir(small) if name.endswith(".parquet")]
    assert len(files) <= 8 and read_store(spark, small).count() == 3
    spark.createDataFrame([(9, "http://h.com/b", page("B new"), at + dt.timedelta(days=2))], schema).write.mode("append").parquet(str(tmp_path / "one"))
    assert feed("one", "p1", small) == both | {"b": "B new"}


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2026, 6, 1)
    schema = "page_id long, url string, html string, fetched_at timestamp"
    first = [(1, "http://h.com/a", page("A one"), at), (2, "http://h.com/b", page("B"), at)]
    second = [(3, "http://h.com/a?ref=x", page("A two"), at + dt.timedelta(days=1))]
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = ingest_stream(stream, store, str(tmp_path / "cp"), link_scope="raw").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.url: r.title for r in read_store(spark, store).collect()}
    assert got == {"http://h.com/a": "A two", "http://h.com/b": "B"}
    batch = build_documents(spark.createDataFrame(second + first[1:], schema), link_scope="raw")
    assert sorted(map(str, read_store(spark, store).collect())) == sorted(map(str, batch.collect()))
    compact(spark, store, str(tmp_path / "small"))
    assert sorted(map(str, read_store(spark, str(tmp_path / "small")).collect())) == sorted(map(str, batch.collect()))
    assert read_store(spark, str(tmp_path / "none")).count() == 0


def test_seen_index_over_runs(spark, tmp_path):
    """A filter of 64 bits knows nearly everything, one of many bits nearly nothing wrong; both give the same."""
    frame = lambda urls: spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, place int")
    first, second = [f"{HOST}/{i}" for i in range(0, 300, 3)], [f"{HOST}/{i}" for i in range(0, 300, 5)]
    asked = [f"{HOST}/{i % 320}" for i in range(400)] + [None]
    want = sorted(str((u, i)) for i, u in enumerate(asked) if u not in set(first + second))
    for name, expected in (("dull", 4), ("sharp", 100_000)):
        index = SeenIndex.open(spark, str(tmp_path / name), buckets=3, expected=expected)
        assert index.unseen(frame(asked)).count() == len(asked)
        for urls in (first, second, first, []):
            index.add(frame(urls))
        again = SeenIndex.open(spark, str(tmp_path / name), buckets=99)
        assert again.table.buckets == 3 and again.table.read().count() == len(set(first + second))
        assert sorted(str(tuple(r)) for r in again.unseen(frame(asked)).collect()) == want
        plan = again.unseen(frame(asked))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftAnti") == 1 and plan.count("getbit") >= 4
        index.close()
