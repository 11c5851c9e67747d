"""The block-wise extractor against a plain walk over tokens, and both extractors in one pass."""

import random
import re

import pytest

from pagemill.operators.extract import extract_fields
from pagemill.operators.precision import _BLOCK_TAGS, extract_both, extract_precise
from pagemill.plans import quality

TAGS = ["p", "div", "li", "b", "i", "a", "a", "td", "span", "br", "h1"]


def random_page(rng):
    parts = [rng.choice(["", "<title>A title | site</title>", "<title></title>", "<title>one</title><title>two</title>"])]
    for _ in range(rng.randrange(0, 40)):
        if rng.random() < 0.5:  # tags in any order, often unclosed or stray
            parts.append(f"<{rng.choice(['', '/'])}{rng.choice(TAGS)}>")
        else:
            parts.append(" ".join(rng.choice(["word", "other", "a&amp;b", "\n"]) for _ in range(rng.randrange(0, 12))) + rng.choice(["", " "]))
    return "".join(parts)


def plain(html, min_words=10, density=0.33):
    block = link = title = 0
    blocks = {}
    for token in re.findall(r"<[^>]*>|[^<]+", html):
        if token.startswith("<"):
            name, sign = re.match(r"</?(\w+)", token)[1], -1 if token.startswith("</") else 1
            block += name in _BLOCK_TAGS
            link += sign * (name == "a")
            title += sign * (name == "title")
            continue
        txt = token.replace("&amp;", "&")
        row = blocks.setdefault(block, [[], 0, 0, title > 0])
        row[0].append(txt)
        row[1] += len(txt.split())
        row[2] += len(txt.split()) if link > 0 else 0
    line = lambda row: " ".join(" ".join(row[0]).split())
    body = "\n".join(line(r) for _, r in sorted(blocks.items()) if not r[3] and r[1] >= min_words and r[2] <= r[1] * density)
    heads = [line(r) for _, r in sorted(blocks.items()) if r[3]]
    return (heads[0] if heads else "", body) if body else None


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(12)
    rows = [(i, random_page(rng)) for i in range(300)] + [(300, ""), (301, None), (302, "<article>" + "long text here " * 40_000 + "</article>"), (303, "<li>a b" * 3000)]
    return rows, spark.createDataFrame(rows, "page_id long, html string")


def test_blocks_equal_a_plain_walk(pages):
    rows, df = pages
    got = {r.page_id: (r.title, r.body_text) for r in extract_precise(df).collect()}
    want = {i: plain(html) for i, html in rows if html and i < 302}
    assert {i: v for i, v in got.items() if i < 302} == {i: v for i, v in want.items() if v}
    assert sum(v is not None for v in want.values()) > 50 and 302 in got and 303 not in got


def test_one_pass_gives_what_each_extractor_gives(spark, pages):
    _, df = pages
    key = lambda r: (r.page_id, r.title, r.body_text, sorted(r.meta.items()), r.html_length)
    both = extract_both(df).collect()
    for name, alone in (("heuristic", extract_fields(df)), ("precision", extract_precise(df))):
        assert sorted(key(r) for r in both if r.extractor == name) == sorted(map(key, alone.collect()))
    best = {r.page_id: tuple(r) for r in quality.best_rows(extract_both(df)).collect()}
    assert best == {r.page_id: tuple(r) for r in quality.best_extraction({"precision": extract_precise(df), "heuristic": extract_fields(df)}).collect()}


def test_both_extractors_read_one_exchange(spark, tmp_path):
    spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string").write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = quality.best_rows(extract_both(spark.read.parquet(str(tmp_path / "p"))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in plan.split("\n") if "Exchange " in line and "ReusedExchange" not in line]
    assert len(made) == 1 and "hashpartitioning(page_id" in made[0]
    assert plan.count("Generate posexplode") <= 2  # tags of the structure, once
