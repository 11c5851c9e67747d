"""Extraction against a walk over the trees that random pages were written from."""

import random
import re

from pyspark.sql import functions as F

from pagemill.operators.elements import CONTENT_NAMES, NOISE_PATTERN, NOISE_TAGS
from pagemill.operators.extract import copartitioned, extract_fields, page_layout, page_links
from pagemill.plans.documents import parse_pages

NOISE = re.compile(NOISE_PATTERN)
BLOCKS = ["div", "div", "div", "section", "article", "main", "nav", "footer", "aside", "header", "noscript", "ul"]
CLASSES = ["", "", "", "post", "x content", "side-menu", "lead", "Cookie", "body"]


def tree(rng, depth=0):
    """A random element ``(tag, class, id, role, children)``; strings are text."""
    tag = rng.choice(BLOCKS) if depth else "body"
    if tag == "ul":
        items = [("li", rng.choice(CLASSES), "", "", [f"item{rng.randint(0, 9)}"]) for _ in range(rng.randint(1, 3))]
        return (tag, "", "", "", items)
    kids = []
    for _ in range(rng.randint(0, 4)):
        kids.append(tree(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else f"w{rng.randint(0, 999)} z")
    attrs = (rng.choice(CLASSES), rng.choice(["", "", "", "main", "navbar"]), rng.choice(["", "", "", "main"])) if depth else ("", "", "")
    return (tag, *attrs, kids)


def write(node, rng):
    if isinstance(node, str):
        return node
    tag, cls, ident, role, kids = node
    attrs = "".join(f' {n}="{v}"' for n, v in (("class", cls), ("id", ident), ("role", role)) if v)
    inner = "<br>".join(write(k, rng) for k in kids)
    end = "" if tag == "li" and rng.random() < 0.5 else f"</{tag}>"
    return f"<{tag}{attrs}>{inner}{end}"


def clean(node):
    if isinstance(node, str):
        return node
    tag, cls, ident, role, kids = node
    if tag in NOISE_TAGS or NOISE.search(cls) or NOISE.search(ident):
        return None
    return (tag, cls, ident, role, [k for k in map(clean, kids) if k is not None])


def texts(node):
    return [node] if isinstance(node, str) else [t for k in node[4] for t in texts(k)]


def walk(node, parent=None):
    if not isinstance(node, str):
        yield node, parent
        for kid in node[4]:
            yield from walk(kid, node)


def expected(root):
    root = clean(root)
    tests = [lambda n: n[0] == "main", lambda n: n[0] == "article", lambda n: n[3] == "main"]
    tests += [lambda n, c=c: n[0] == "div" and c in n[1].split() for c in CONTENT_NAMES]
    tests += [lambda n, c=c: n[0] == "div" and n[2] == c for c in CONTENT_NAMES]
    for test in tests:
        first = next(((n, p) for n, p in walk(root) if test(n)), None)
        if first and texts(first[0]):
            node, parent = first
            alike = parent and sum(not isinstance(k, str) and test(k) for k in parent[4]) > 1
            return "\n".join(texts(parent if alike else node))
    return "\n".join(texts(root))


def test_random_pages(spark):
    rng = random.Random(3)
    trees = [tree(rng) for _ in range(400)]
    rows = [(i, f"<html><head><title>t</title></head>{write(t, rng)}</html>") for i, t in enumerate(trees)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.body_text for r in extract_fields(pages).collect()}
    for i, root in enumerate(trees):
        assert got.get(i, "") == expected(root), rows[i][1]


def test_one_exchange_serves_all_windows(spark, tmp_path):
    spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layout = page_layout(copartitioned(pages, "page_id", ("page_id", "html")))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (layout, extract_fields(pages))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for plan in plans:
        # The second side of the text join reads the same exchange again.
        made = [line for line in plan.split("\n") if "Exchange hashpartitioning(page_id" in line and "ReusedExchange" not in line]
        assert len(made) == 1
        assert "Python" not in plan


def test_pages_with_links_are_exchanged_once_and_for_raw_links_not_at_all(spark, tmp_path):
    spark.createDataFrame([(1, "http://h.com/", "<p>x</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p")).withColumn("fetched_at", F.current_timestamp())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parsed, raw = (df._jdf.queryExecution().executedPlan().toString() for df in (parse_pages(pages), page_links(pages, scope="raw")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Besides the pages, only their addresses move.
    made = [line for line in parsed.split("\n") if "Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
    assert sorted("REPARTITION_BY_COL" in line for line in made) == [False, True]
    assert "REPARTITION_BY_COL" not in raw and raw.count("Exchange") == 1
