"""Phrases by best-first growth against counting everything."""

import random
import re
from collections import Counter

import pytest

from pagemill.llm.collocations import collocations, cut_words

SCHEMA = "lang string, text string, phrase string, n string, score string"


def brute(rows, limit, least, percent=50):
    langs = {}
    for lang, text in rows:
        f = langs.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                f.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in langs.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in found.items():
            if any(q != p and len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, total, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:limit])]
    return sorted(out)


def run(spark, rows, **how):
    return sorted(tuple(r) for r in collocations(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **how).collect())


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ünd", "a-b", "naïve", "X1"]
    fixed = ["red hot iron", "out of bounds", "X1 Ünd", "in the the"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words[:rng.choice([4, 10, 44])]) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " "]) for p in parts)))
    return rows + [("en", None), ("fr", ""), ("fr", " ,. "), ("ru", "lone")]


@pytest.mark.parametrize("how", [
    {"limit": 2000, "least": 10}, {"limit": 5, "least": 2, "ahead": 1}, {"limit": 20, "least": 3, "ahead": 1}, {"limit": 1, "least": 2, "ahead": 1},
    {"limit": 30, "least": 2, "ahead": 2, "percent": 90}])
def test_random_texts(spark, how):
    rows = random_rows(8)
    assert run(spark, rows, **how) == brute(rows, how["limit"], how["least"], how.get("percent", 50))


def test_ties_at_the_limit(spark):
    rows = [("en", f"a{k} b{k}.") for k in range(40) for _ in range(3)]
    assert run(spark, rows, limit=7, least=3, ahead=1) == brute(rows, 7, 3)


def test_a_long_text_and_a_hot_phrase(spark):
    rows = [("en", "very common pair " * 30_000), ("en", "very common " + "x" * 100_000)] + random_rows(9, 50)
    assert run(spark, rows, limit=10, least=2, ahead=1) == brute(rows, 10, 2)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", "one two three")]) == []


def test_cutting():
    block = cut_words("en", ["A b\tc.d\x0be".encode(), "É  f".encode()])
    assert [block.words[i].as_py() for i in block.codes] == ["a", "b", "c", "d", "e", "É", "f"]
    assert block.follows.tolist() == [True, True, False, False, False, True]
