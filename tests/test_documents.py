"""Enrichment, filters, storage, contract and report on fixture rows."""

import datetime as dt
import hashlib
import json
import os
import random
import re
import shutil
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.config import CrawlConfig
from pagemill.functions import entities
from pagemill.functions.text import SPACE, has_words, strip, word_count
from pagemill.operators import admit, enrich, language, upsert
from pagemill.operators.language import detect_language, train_profile
from pagemill.plans import contract, extractors, quality, report
from pagemill.schema import DOCUMENT_SCHEMA
from pagemill.sources import collection, fetches, files

BODY = "Rivers carry silt, and the delta grows a little with every flood of the spring. " * 16
PARSED = "page_id long, url string, title string, body_text string, meta map<string,string>, html_length long, links_internal array<string>, fetched_at timestamp"


def parsed_rows(spark, *urls):
    at = dt.datetime(2026, 6, 1, 12, 0, 0)
    links = ["https://delta.example.org/silt", "https://delta.example.org/floods"]
    return spark.createDataFrame(
        [(i, u, "How deltas grow", BODY, {"description": "Silt", "author": "M. Ruiz"}, 6400, links, at) for i, u in enumerate(urls)], PARSED)


def test_complete_document(spark):
    samples = [(BODY, "en"), ("Der Fluss trägt Sand und Schlamm bis an die Küste, wo das Wasser ruhig wird. " * 5, "de")]
    profile = train_profile(spark.createDataFrame(samples, "text string, lang string"))
    rows = parsed_rows(spark, "https://delta.example.org/growth")
    doc = enrich.assemble_documents(rows, detect_language(rows, profile, "page_id")).first()
    assert doc.doc_id == hashlib.sha256(b"https://delta.example.org/growth").hexdigest()[:16]
    assert (doc.source, doc.title, doc.fetched_at) == ("delta.example.org", "How deltas grow", "2026-06-01T12:00:00Z")
    assert (doc.word_count, doc.char_count, doc.text_to_html_ratio) == (240, 1280, 0.2)
    assert (doc.language, doc.content_type) == ("en", "other")
    assert json.dumps(doc.asDict())
    score = rows.select(quality.extraction_score(F.col("title"), F.col("body_text"), F.col("meta"), F.col("html_length"))).first()[0]
    assert score == pytest.approx(0.4 + 0.2 + 0.15 + 0.1, abs=6e-4)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_time_is_utc_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.sql("select timestamp '2026-06-01 12:00:00Z' as t").select(enrich.utc_text(F.col("t"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == "2026-06-01T12:00:00Z"


TYPES = [
    ("https://delta.example.org/field-notes/autumn", "tide " * 512, 7, "article"),
    ("https://delta.example.org/manual/gauges/", "Read the gauge at dawn. " * 12, 1, "reference"),
    ("https://tools.example.org/shop/rain-gauge/", "Copper rain gauge, now ¥3200 with a stand", 2, "product"),
    ("https://delta.example.org/team/wardens/", "She keeps the north lock and its log book. " * 4, 0, "profile"),
    ("https://delta.example.org/", "All stations by river, upstream first.", 14, "listing"),
    ("https://tools.example.org/questions/", "Does it rust? Is frost a problem? Which screws fit? May it hang?", 1, "faq"),
    ("https://tools.example.org/opening-hours", "Closed on Mondays and in heavy rain.", 3, "other"),
    # Further rows by the scoring rules.
    ("https://e.com/aboutness", "x", 0, "profile"),
    ("https://e.com/a", "entrepreneur 5", 0, "product"),
    ("https://e.com/shop/x", "Word " * 800, 0, "article"),
    ("https://e.com/docs/shop/", "x", 0, "reference"),
    ("https://e.com/", "w " * 99, 6, "listing"),
    ("https://e.com/", "w " * 100, 6, "other"),
    ("https://e.com/", "w " * 300, 15, "other"),
    ("https://e.com/docs", "x", 0, "other"),
]


@pytest.mark.parametrize("url, body, links, expected", TYPES)
def test_content_type(spark, url, body, links, expected):
    from pagemill.functions.text import word_count
    df = spark.createDataFrame([(url, body, links)], "url string, body string, links int")
    got = df.select(enrich.content_type(F.col("url"), F.col("body"), word_count(F.col("body")), F.col("links"))).first()[0]
    assert got == expected


URLS = [
    ("https://delta.example.org/tides/spring", None), ("https://delta.example.org/tides/spring", "duplicate"),
    ("https://delta.example.org/charts/mouth.zip", "extension"), ("https://delta.example.org/lock.webp", "extension"),
    ("https://delta.example.org/signin", "non_content"), ("https://delta.example.org/cart/gauges", "non_content"),
    ("https://delta.example.org/log/7", None), ("https://delta.example.org/charts/mouth.zip", "duplicate"),
    ("https://delta.example.org/api/v1", None), ("https://delta.example.org/api//x", "non_content"),
    ("https://delta.example.org/v1.2/x", None), ("https://delta.example.org/X.PDF", "extension"),
    ("https://delta.example.org/stored", "duplicate"),
]


def test_admission(spark):
    urls = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "rank int, url string")
    seen = spark.createDataFrame([("https://delta.example.org/stored",)], "url string")
    got = admit.admit_urls(urls, seen).orderBy("rank").collect()
    assert [r.reject_reason for r in got] == [reason for _, reason in URLS]
    kept = {r.url for r in admit.admitted_urls(urls, seen).collect()}
    assert kept == {u for u, reason in URLS if reason is None}
    assert admit.seen_count(urls, seen).first()[0] == len({u for u, _ in URLS})


def test_reject_counts_equal_the_judged_rows(spark):
    urls = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "rank int, url string")
    seen = spark.createDataFrame([("https://delta.example.org/stored",), ("https://delta.example.org/log/7",)], "url string")
    for stored in (None, seen):
        rows = admit.admit_urls(urls, stored).groupBy(F.coalesce("reject_reason", F.lit("admitted"))).count().collect()
        assert sorted(map(tuple, admit.reject_counts(urls, stored).collect())) == sorted(map(tuple, rows))


def test_admission_prefix_and_regex(spark):
    urls = spark.createDataFrame([(1, "https://delta.example.org/Guides/locks"), (2, "https://delta.example.org/log/2024/flood")], "rank int, url string")
    by = lambda **rule: [r.reject_reason for r in admit.admit_urls(urls, **rule).orderBy("rank").collect()]
    assert by(prefix="/guides/") == [None, "prefix"]
    assert by(regex=r"/log/\d{4}/") == ["regex", None]


def test_storage_round_trip(spark, tmp_path):
    docs = enrich.assemble_documents(parsed_rows(spark, "https://delta.example.org/silt", "https://delta.example.org/floods"))
    path = str(tmp_path / "out" / "collection")
    assert collection.save_documents(docs, path) == 2
    loaded = {r.doc_id: r for r in collection.load_documents(spark, path).collect()}
    ids = [hashlib.sha256(f"https://delta.example.org/{name}".encode()).hexdigest()[:16] for name in ("silt", "floods")]
    assert set(loaded) == set(ids)
    assert loaded[ids[0]] == docs.where(F.col("doc_id") == ids[0]).first()
    assert collection.save_documents(docs.where("false"), path) == 0
    assert collection.load_documents(spark, path).count() == 2
    # Read, merge and save back onto the same path.
    merged = upsert.upsert(collection.load_documents(spark, path), docs.withColumn("title", F.lit("new")))
    assert collection.save_documents(merged, path) == 2
    assert {r.title for r in collection.load_documents(spark, path).collect()} == {"new"}
    # An empty save lists no version, and what nobody lists does not count.
    assert sorted(os.listdir(f"{path}/_versions")) == ["1", "2"]
    shutil.copytree(f"{path}/data", f"{path}/data/unfinished")
    assert collection.load_strict(spark, path, DOCUMENT_SCHEMA).count() == 2
    lines = [json.loads(r.value) for r in collection.read_lines(spark, path).collect()]
    assert list(lines[0]) == DOCUMENT_SCHEMA.names and lines[0]["language"] is None


def many_documents(spark, ids, title="old"):
    rows = spark.createDataFrame([(i,) for i in ids], "n int").select(F.concat(F.lit("https://h.com/"), "n").alias("url"), F.lit(title).alias("title"))
    rows = rows.withColumns({"page_id": F.lit(1), "body_text": F.lit("text"), "html_length": F.lit(9), "fetched_at": F.lit(None).cast("timestamp"), "links_internal": F.lit(None).cast("array<string>")})
    return enrich.assemble_documents(rows)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.save_documents(many_documents(spark, range(300)), path, buckets=16)
    before = set(collection.current_places(spark, path))
    new = many_documents(spark, [7, 1000], "new")
    touched = {r["k"] for r in new.select(collection.bucket_of(F.col("doc_id"), 16).alias("k")).collect()}
    stored = {k: collection._documents(collection._lines(spark, [p])).count() for p in before if (k := int(p.rpartition("=")[2])) in touched}
    assert collection.upsert_documents(new, path) == sum(stored.values()) + 1
    after = set(collection.current_places(spark, path))
    assert {int(p.rpartition("=")[2]) for p in after - before} == touched and len(after) == len(before) == 16
    titles = {r.url: r.title for r in collection.load_documents(spark, path).collect()}
    assert len(titles) == 301 and {u for u, t in titles.items() if t == "new"} == {"https://h.com/7", "https://h.com/1000"}
    assert collection.upsert_documents(new.where("false"), path) == 0
    for _ in range(4):  # old versions go, and only buckets that no kept version names
        collection.upsert_documents(new, path)
    assert sorted(map(int, os.listdir(f"{path}/_versions"))) == [4, 5, 6]
    assert collection.load_documents(spark, path).count() == 301


def test_savers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    collection.save_documents(many_documents(spark, range(20)), path, buckets=2)
    errors = []

    def save(k):
        try:
            collection.upsert_documents(many_documents(spark, range(100 * k, 100 * k + 5), f"saver {k}"), path)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=save, args=(k,)) for k in (1, 2, 3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    titles = [r.title for r in collection.load_documents(spark, path).collect()]
    assert {t: titles.count(t) for t in set(titles)} == {"old": 20, "saver 1": 5, "saver 2": 5, "saver 3": 5}


def test_upsert_into_plain_lines_and_into_nothing(spark, tmp_path):
    plain, none = str(tmp_path / "plain"), str(tmp_path / "none")
    many_documents(spark, range(5)).write.json(plain)
    for path, want in ((plain, 6), (none, 2)):
        collection.upsert_documents(many_documents(spark, [4, 9], "new"), path)
        titles = [r.title for r in collection.load_documents(spark, path).collect()]
        assert len(titles) == want and titles.count("new") == 2


def test_publish_once(spark, tmp_path):
    place = str(tmp_path / "deep" / "1")
    assert [files.publish(spark, place, text) for text in ("first \u00e9", "second")] == [True, False]
    assert files.read_text(spark, place) == "first \u00e9" and files.names_in(spark, str(tmp_path / "deep")) == ["1"]


def test_tolerant_read(spark, tmp_path):
    base = dict(doc_id="a", source="s", url="u", title="t", body_text="b", fetched_at="f", word_count=1, char_count=1)
    lines = ["", "not json", "[1]", "5", json.dumps({k: v for k, v in base.items() if k != "title"}),
             json.dumps(base | {"doc_id": "n", "title": None}), json.dumps(base | {"extra": 1}),
             json.dumps(base | {"title": "later", "language": "en", "text_to_html_ratio": 0.5, "links_out_internal": ["x"]}), "  "]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    docs = {r.doc_id: r for r in collection.load_documents(spark, str(path)).collect()}
    assert set(docs) == {"a", "n"}
    assert docs["a"].title == "later" and docs["a"].language == "en" and docs["a"].links_out_internal == ["x"]
    assert docs["n"].title is None and docs["n"].language is None
    assert docs["n"].text_to_html_ratio == 0.0 and docs["n"].links_out_internal == []
    report_rows = {r.status: r.lines for r in collection.skip_report(collection.parse_lines(collection.read_lines(spark, str(path)))).collect()}
    assert report_rows == {"loaded": 3, "malformed": 3, "missing_key": 1}
    assert collection.load_documents(spark, str(tmp_path / "none")).count() == 0


def test_lines_are_judged_as_whole_json(spark, tmp_path):
    base = dict(doc_id="a", source="s", url="u", title="t", body_text="b", fetched_at="f", word_count=1, char_count=1)
    good = json.dumps(base)
    bad = [good + " trailing", good + good, good + "," + good, good.replace('"', "'"), good[:-1], "{}" + good, '"{' + good]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(["\t" + good, "\xa0" + good + "\u3000", *bad, "\x0c"]), encoding="utf-8")
    parsed = collection.parse_lines(collection.read_lines(spark, str(path)))
    assert parsed.where("skip_reason is null").count() == 2
    skipped = collection.skipped_lines(parsed).collect()
    assert sorted(r.value for r in skipped) == sorted(bad) and {r.skip_reason for r in skipped} == {"malformed"}
    assert {os.path.basename(r.file) for r in skipped} == {"c.jsonl"}


def test_strict_read(spark, tmp_path):
    good, bad, empty = tmp_path / "g", tmp_path / "b", tmp_path / "e"
    good.write_text('{"a":1}\n\n{"a":1}\n'), bad.write_text('{"a":1}\nnope\n'), empty.write_text("\n")
    assert collection.load_strict(spark, str(good)).count() == 2
    with pytest.raises(Exception):
        collection.load_strict(spark, str(bad), "a int").collect()
    with pytest.raises(ValueError):
        collection.load_strict(spark, str(empty), "a int")


def test_fetch_outcomes(spark):
    rows = [("u1", None, 200, "Text/HTML; charset=utf-8", None, "h", None), ("u2", "f", 404, "text/html", None, "h", None),
            ("u3", None, 200, "application/pdf", None, "h", None), ("u4", None, 200, "text/html", 5 * 1024 * 1024 + 1, "h", None),
            ("u5", None, None, None, None, None, "request timed out"), ("u6", None, 200, None, 9, "h", None)]
    df = spark.createDataFrame(rows, "url string, final_url string, status_code int, content_type string, content_length long, html string, error string")
    got = {r.url: r for r in fetches.judge_fetches(df).collect()}
    assert [got[f"u{i}"].error for i in range(1, 7)] == [
        None, "HTTP 404", "non-HTML content type: application/pdf", "response too large: 5242881 bytes", "request timed out",
        "non-HTML content type: "]
    assert got["u5"].status_code == 0 and got["u2"].final_url == "f" and got["u2"].html is None and got["u1"].success


def test_judging_twice_keeps_the_recorded_error(spark):
    schema = "url string, final_url string, status_code int, content_type string, content_length long, html string, error string"
    df = spark.createDataFrame([("a", None, 0, None, None, None, "request timed out"), ("b", None, 200, "text/html", 90, "h", None)], schema)
    once = fetches.judge_fetches(df)
    assert sorted(map(str, fetches.judge_fetches(once).collect())) == sorted(map(str, once.collect()))
    assert {r.url: r.error for r in once.collect()} == {"a": "request timed out", "b": None}
    assert fetches.judge_fetches(df, max_length=80).where("url = 'b'").first().error == "response too large: 90 bytes"


@pytest.mark.parametrize("moment, valid", [
    ("2026-06-01T12:00:00z", True), ("2026-06-01t12:00:00Z", True), ("2016-12-31T23:59:60Z", True), ("2026-06-01T12:00:00.25+02:00", True),
    ("2026-06-01 12:00:00Z", False), ("2026-06-31T12:00:00Z", False), ("2026-06-01T24:30:00Z", False), ("2026-06-01T12:00:00", False)])
def test_contract_dates(spark, moment, valid):
    docs = enrich.assemble_documents(parsed_rows(spark, "https://delta.example.org/silt")).withColumn("fetched_at", F.lit(moment))
    assert [r.rule for r in quality.contract_violations(docs).collect()] == ([] if valid else ["fetched_at.format"])


def test_contract(spark):
    docs = enrich.assemble_documents(parsed_rows(spark, "https://delta.example.org/silt"))
    assert quality.contract_violations(docs).count() == 0
    bad = docs.withColumns({"source": F.lit(""), "language": F.lit("x"), "content_type": F.lit("unknown"), "url": F.lit("a b"),
                            "fetched_at": F.lit("2026-13-01T00:00:00Z"), "word_count": F.lit(-1), "title": F.lit(None).cast("string"),
                            "links_out_internal": F.array(F.lit("no uri")), "more": F.lit(1)})
    assert {r.rule for r in quality.contract_violations(bad).collect()} == {
        "source.minLength", "language.minLength", "content_type.enum", "url.format", "fetched_at.format", "word_count.minimum",
        "title.required", "links_out_internal.format", "more.additionalProperties"}
    own = contract.document_contract()
    own["properties"]["content_type"]["enum"] = ["unknown", None]
    assert quality.contract_violations(bad, own).where("rule like 'content_type%'").count() == 0


def test_a_contract_from_a_file(spark, tmp_path):
    schema = {"type": "object", "required": ["id", "maybe"], "properties": {
        "id": {"type": "integer", "minimum": 1, "maximum": 9}, "maybe": {"type": ["string", "null"], "pattern": "^a"}, "kind": {"const": "x", "maxLength": 1},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 2, "enum": ["ab", "cd", "e"]}}}}
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(schema), encoding="utf-8")
    rows = [(1, "abc", "x", ["ab", "cd"], 1), (0, None, "yy", [], 2), (10, "ba", None, ["ab", "ab", "e"], 3), (None, None, None, None, 4), (5, "a", "x", [None, "zz"], 5)]
    df = spark.createDataFrame(rows, "id int, maybe string, kind string, tags array<string>, extra int")
    got = sorted(map(tuple, quality.contract_violations(df, contract.load_contract(spark, str(path)), key="extra").collect()))
    assert got == sorted([
        (2, "id.minimum"), (2, "kind.maxLength"), (2, "kind.const"), (2, "tags.minItems"), (3, "id.maximum"), (3, "maybe.pattern"), (3, "tags.uniqueItems"), (3, "tags.minLength"),
        (4, "id.required"), (5, "tags.enum")])
    assert quality.contract_violations(df, schema | {"additionalProperties": False}, key="id").where("rule = 'extra.additionalProperties'").count() == 5
    for rule in ({"format": "ipv6"}, {"multipleOf": 2}):
        with pytest.raises(ValueError):
            contract.compile_rules({"properties": {"id": rule}})


def test_report(spark):
    rows = [("1", "a", "article", "en", 100, 0.5), ("2", "a", None, None, 10, 0.5), ("3", "b", "article", "en", 49, 0.5),
            ("4", "b", "other", "de", 51, float("nan")), ("5", None, "other", "de", 50, 0.03)]
    docs = spark.createDataFrame([(i, s, "t", "2026", w, w * 2, la, c, r) for i, s, c, la, w, r in rows],
        "doc_id string, source string, title string, fetched_at string, word_count long, char_count long, language string, content_type string, text_to_html_ratio double")
    assert report.overview(docs).first().asDict() == dict(documents=5, sources=2, first_fetch="2026", last_fetch="2026", words=260, chars=520)
    assert [tuple(r) for r in report.type_breakdown(docs).collect()] == [("article", 2, 40.0, 74), ("other", 2, 40.0, 50), ("null", 1, 20.0, 0)]
    assert [tuple(r) for r in report.language_breakdown(docs).collect()] == [("de", 2, 40.0), ("en", 2, 40.0), ("undetected", 1, 20.0)]
    assert tuple(report.readiness(docs).first()) == (1, 5, 20.0, 4)
    assert tuple(report.readiness(docs.drop("text_to_html_ratio")).first()) == (0, 5, 0.0, 5)
    assert tuple(report.readiness(docs.where("false")).first()) == (0, 0, 0.0, 0)
    assert report.mean_words(docs).first()[0] == 52
    assert report.first_source(docs, "doc_id").first()[0] == "a" and report.first_source(docs.where("false"), "doc_id").first()[0] == "unknown"
    assert report.count_on_domain(docs, "b").first()[0] == 2
    long = {(r.section, r.key, r.metric): r.value for r in report.report(docs).collect()}
    assert long["content_type", "null", "mean_words"] == "0" and long["content_type", "article", "percent"] == "40.0"
    assert long["overview", "all", "sources"] == "2" and long["readiness", "all", "percent"] == "20.0"
    assert long["overview", "all", "mean_words"] == "52" and long["language", "undetected", "documents"] == "1"


def test_upsert_replay_changes_nothing(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "doc_id string, title string, n int")
    new = spark.createDataFrame([("b", "new", 3), ("c", "new", 4)], "doc_id string, title string, n int")
    once = upsert.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "old", 1), ("b", "new", 3), ("c", "new", 4)]
    assert sorted(map(tuple, upsert.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_config_rules():
    good = dict(start_url="https://docs.com", output_path="/tmp/x")
    assert CrawlConfig(**good, max_pages=10, allowed_path_prefix=" /docs ").allowed_path_prefix == "/docs"
    for bad in (dict(start_url="ftp://x"), dict(start_url="https://"), dict(output_path=" "), dict(max_pages=0), dict(max_depth=-1),
                dict(extractor="none"), dict(allowed_path_prefix="docs"), dict(allowed_path_regex="("),
                dict(allowed_path_prefix="/a", allowed_path_regex="b")):
        with pytest.raises(ValueError):
            CrawlConfig(**{**good, **bad})
    class Args:
        start_url, output, max_pages = "https://docs.com", "/tmp/x", 7
    assert CrawlConfig.from_namespace(Args()).max_pages == 7


def test_unknown_extractor():
    with pytest.raises(ValueError):
        extractors.get_extractor("none")


def test_line_numbers_over_splits(spark, tmp_path):
    """Two files whose lines fall into many splits, with blank and skipped lines among them."""
    good = json.dumps(dict(doc_id="a", source="s", url="u", title="t", body_text="b" * 60, fetched_at="f", word_count=1, char_count=1))
    rng, want = random.Random(5), []
    for name in ("one", "two"):
        lines = [rng.choice([good, good, good, "", "  ", "bad " + "x" * rng.randrange(200), "{}"]) for _ in range(400)]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
        want += [(name, i, "missing_key" if line == "{}" else "malformed", line) for i, line in enumerate(lines, 1) if line.startswith(("bad", "{}"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = collection.skipped_line_numbers(spark, str(tmp_path)).collect()
        assert collection.read_lines(spark, str(tmp_path)).select("file", "at.block").distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file.rpartition("/")[2], r.line, r.skip_reason, r.value) for r in found) == sorted(want)


def test_both_ways_to_score_a_language_agree(spark):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "xyz", "dd": "abcde"}  # aa and dd tie where they were taught alike
    text = lambda alphabet, n: " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(n))
    taught = [(text(a, 30), lang) for lang, a in letters.items() for _ in range(3)] + [(None, "aa"), ("word", None)]
    profile = train_profile(spark.createDataFrame(taught, "text string, lang string"))
    rows = [(i, text(rng.choice([*letters.values(), "abcdefgxyz", "\u03b1\u03b2"]), rng.choice([5, 19, 20, 60, 3000]))) for i in range(60)] + [(60, None), (61, "")]
    texts = spark.createDataFrame(rows, "id int, body_text string")
    ways = [dict(map(tuple, detect_language(texts, profile, "id", **how).collect())) for how in ({}, {"in_memory": 0}, {"in_columns": 2})]
    assert ways[0] == ways[1] == ways[2] and len(set(ways[0].values())) > 2
    plan = detect_language(texts, profile, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(gram" not in plan.partition("BroadcastExchange")[0]


def test_trigrams_are_counted_without_a_row_each(spark):
    rows = [("aa", "Ab1c \U0001f600 \u00c9t\u00e9"), ("aa", "abab"), ("bb", ""), ("bb", None), (None, "xy"), ("cc", "\U00010400\u4e2d" * 3)]
    counts = language.count_trigrams(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    want = Counter()
    for lang, text in rows:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        letters = " " + re.sub(" +", " ", letters) + " " if text is not None else ""
        letters = re.sub("^  | +$", " ", letters)
        want.update((lang, letters[i : i + 3]) for i in range(len(letters) - 2))
    assert {(r.lang, r.gram): r.n for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_portions_of_texts_lose_no_trigram(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab \u00e9\U00010400", k=k)) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 40, 1000)] + [None]
    want = Counter((i, t[k : k + 3]) for i, t in enumerate(texts) for k in range(len(t or "") - 2))
    for size in (1, 3, 4, 50, 10**6):
        monkeypatch.setattr(language, "PORTION", size)
        got = Counter()
        for codes, rows in language._portions(enumerate(texts)):
            got.update(zip(rows.tolist(), language._written(codes)))
        assert got == want


def test_has_words_agrees_with_their_count(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices("a\u00e9\u2003 \n\u20ac\x1f\x85", k=rng.randrange(60))),) for _ in range(400)] + [("",), (None,), (" ".join("a" * 20),), (" ".join("a" * 19) + "  ",)]
    body = F.col("text")
    found = spark.createDataFrame(rows, "text string").select(*[(word_count(body) >= n).eqNullSafe(has_words(body, n)).alias(f"n{n}") for n in (1, 2, 19, 20)])
    assert all(all(r) for r in found.collect())


def test_references_are_decoded_alike_by_both_ways(spark):
    """Texts of few different references, whose replacements would make up new ones, and of many; non-characters among them."""
    rng = random.Random(9)
    parts = ["&", "&&#97;mp;", "&amp;", "&amp", "&lt", "&lt;", "&ltx", "&copy", "&copyx;", "&#38;", "lt;", "amp;", "#97;", "&#0097;", "&#xe9", "&#", "&#x", "&eacute;", " ", "x", ";",
             "&nosuch;", "&#128;", "&#1114112;", "&#64976;", "&#xFDD1;", "\ufdd0", "\n"]
    rows = [("".join(rng.choices(parts[: rng.choice([6, 22, 28])], k=rng.randrange(1, 30))),) for _ in range(400)]
    rows += [("".join(f"&#{c};&#x{c:x}" for c in range(32, 32 + n)),) for n in (10, 32, 33, 200)] + [("",), (None,), ("&",)]
    text = F.col("text")
    found = spark.createDataFrame(rows, "text string").select(text, entities.decode_entities(text).alias("new"), entities._by_piece(text).alias("old")).collect()
    assert all(r.new == r.old for r in found)
    plan = spark.createDataFrame(rows, "text string").select(entities.decode_entities(text))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan  # whole texts, not pieces


def test_line_numbers_run_through_the_files_of_a_folder(spark, tmp_path):
    rng, want = random.Random(6), []
    for part in ("part=0", "part=1"):
        (tmp_path / part).mkdir()
        line = 0
        for name in ("part-00000-x", "part-00001-x", "part-00010-x"):
            lines = [rng.choice(["bad", "", "{}"]) for _ in range(200)]
            (tmp_path / part / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
            want += [(part, line + i, text) for i, text in enumerate(lines, 1) if text]
            line += len(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = collection.skipped_line_numbers(spark, str(tmp_path), by_folder=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file.split("/")[-2], r.line, r.value) for r in found) == sorted(want)


def test_prices_start_with_one_look(spark):
    rng = random.Random(10)
    parts = ["$", "\u20ac", "usd", "Eur", "gBP", "eu", "r", " ", "\u3000", "\n", "5", "\u0665", "x"]
    rows = [("".join(rng.choices(parts, k=rng.randrange(8))),) for _ in range(500)]
    plain = rf"(?i)(?:[$£€¥₹]|USD|EUR|GBP)[{SPACE}]*\p{{Nd}}"
    found = spark.createDataFrame(rows, "body string").select(F.col("body").rlike(plain), F.col("body").rlike(enrich.PRICE)).collect()
    assert all(a == b for a, b in found) and len({a for a, _ in found}) == 2
    assert enrich.PRICE.startswith("(?=")


def test_words_and_ends_are_told_by_no_negated_list(spark):
    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + ["\U0001f600", "\U0010ffff"]
    rng = random.Random(11)
    spaces = [c for c in every if c.isspace()]
    rows = [(t,) for c in every for t in (c, f"{c}a{c}b{c}")] + [("".join(rng.choices([*spaces, *"ab{}"], k=rng.randrange(30))),) for _ in range(500)]
    found = spark.createDataFrame([*rows, ("",), (None,)], "t string").select("t", word_count(F.col("t")).alias("words"), strip(F.col("t")).alias("bare"))
    for r in found.collect():
        assert (r.words, r.bare) == ((None, None) if r.t is None else (len(r.t.split()), r.t.strip())), ascii(r.t)
    # In one job with other patterns a negated list is slow, and a look behind at every character costs more than the parsing of a line.
    for column in (word_count(F.col("t")), strip(F.col("t"))):
        plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(column)._jdf.queryExecution().analyzed().toString()
        assert "[^" not in plan and "(?<!" not in plan
