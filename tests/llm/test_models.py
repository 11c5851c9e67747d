"""Mixing, quality, licences and toxicity: small cases, edge cases and plain versions."""

import itertools
import math
import random
import textwrap
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import licenses, mixing, quality, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, rate string, license_id string, score int"
LABELS = "doc_id bigint, quality int, toxic int, text string"
LONG = "word " * 60_000


def frame(spark, rows):
    """Rows of (doc_id, text, lang); the further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, g, None, None, "a", "b", "c", 1) for i, t, g in rows], SCHEMA).repartition(3)


def best_segments(scores):
    """The definition of maximal scoring segments: take the best one, then look left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    sums = list(itertools.accumulate(scores, initial=0.0))
    n = len(scores)
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(n) for j in range(i + 1, n + 1)))
    first, last = -best[2], -best[2] - best[1] - 1
    right = [(a + last + 1, b + last + 1, s) for a, b, s in best_segments(scores[last + 1:])]
    return [*best_segments(scores[:first]), (first, last, best[0]), *right]


@pytest.mark.parametrize("rise", [-1.0, 1.0, 0.0])
def test_a_million_hits_take_linear_time(rise):
    """Totals that fall, rise or swing: each candidate is passed once."""
    n = 1_000_000
    hits = [(2 * i, 1.0 + rise * 0.5 + (0.4 if i % 7 == 0 else 0.0)) for i in range(n)]
    start = time.perf_counter()
    found = toxicity.segments(hits, 1.0)
    assert time.perf_counter() - start < 10
    assert found[0][0] == 0 and found[-1][1] == 2 * (n - 1)


def test_segments_are_the_maximal_ones():
    dice = random.Random(4)
    for _ in range(200):
        n, drift = dice.randrange(1, 30), 1.0
        hits = [(i, dice.choice([0.7, 1.9, 3.3]) + dice.random()) for i in range(n) if dice.random() < 0.3]
        scores = [-drift] * n
        for i, s in hits:
            scores[i] = s
        got = toxicity.segments(hits, drift)
        want = best_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


@pytest.fixture(scope="module")
def toxic_case(spark):
    dice = random.Random(8)
    plain = ["river", "stone", "house", "garden", "window", "letter", "music", "silver"]
    rows, labels = [], []
    for i in range(400):
        words = dice.choices(plain, k=dice.randrange(5, 80))
        if i % 5 == 0:
            for _ in range(3):
                words.insert(dice.randrange(len(words)), dice.choice(["vilegrub", "vilemudly"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(i % 5 == 0), "clash"))
    labels += [(5000, 1, 1, "no such document"), (1, 1, None, ""), (None, 1, 1, "")]
    return rows, labels, toxicity.train(frame(spark, rows), spark.createDataFrame(labels, LABELS))


def test_toxicity(spark, toxic_case):
    rows, _, model = toxic_case
    tests = [(1, "the river and VILEGRUB!!! in the garden", None), (2, None, None), (3, "", None), (4, "vilemudost " * 3 + LONG, None), (5, "river stone", None),
             (5, "river stone", None), (None, "vilegrub vilegrub", None), (6, LONG, None)]
    got = toxicity.score(frame(spark, tests), model).collect()
    assert len(got) == len(tests) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    flags = {r.doc_id: r.predicted for r in got}
    assert flags == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0, None: 1}
    assert {r.doc_id: r.passages for r in got}[1] == "3:3"
    again = {r.doc_id: r.predicted for r in toxicity.score(frame(spark, rows), model).collect()}
    assert all(again[i] == (i % 5 == 0) for i in range(400))


def test_toxicity_without_labels(spark):
    model = toxicity.train(frame(spark, [(1, "a", None)]), spark.createDataFrame([(1, 1, 0, "")], LABELS))
    assert [(r.score, r.predicted) for r in toxicity.score(frame(spark, [(1, "a", None)]), model).collect()] == [(0.0, 0)]
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def quality_rows():
    dice = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = dice.choices(["river", "stone", "house", "garden", "window", "letter"], k=dice.randrange(20, 120))
        good = i % 4 != 0
        rows.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "$$#" for w in words), "en"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), 0, "clash"))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    labels += [(9000, 1, 0, ""), (None, 0, 0, ""), (1, None, None, "")]
    model = quality.train(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    tests = [*rows, (700, None, None), (701, "", None), (702, LONG, None), (None, "River stone house garden window letter. " * 5, "en"), (3, rows[3][1], "en")]
    got = quality.score(frame(spark, tests), model).collect()
    assert len(got) == len(tests) and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    keep = {r.doc_id: r.keep for r in got}
    assert all(keep[i] == (i % 4 != 0) for i in range(600)) and keep[None]
    stay = quality.keep_good(frame(spark, tests), model)
    assert stay.columns == frame(spark, rows[:1]).columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in got if r.keep)


def test_quality_without_labels(spark):
    model = quality.train(frame(spark, [(1, "a", None)]), spark.createDataFrame([], LABELS))
    assert [r.score for r in quality.score(frame(spark, [(1, "a", None)]), model).collect()] == [1.0]
    assert quality.keep_good(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_views_teach_each_other():
    """Few labels; the first view sees the class only where the second one taught it."""
    dice = np.random.default_rng(0)
    truth = dice.integers(0, 2, 2000)
    first = np.stack([np.where(truth == 1, 1.0, -1.0) + dice.normal(0, 0.6, 2000), dice.normal(0, 1, 2000)], axis=1)
    second = np.stack([np.where(truth == 1, 1.0, -1.0) + dice.normal(0, 0.6, 2000), dice.normal(0, 1, 2000)], axis=1)
    y = np.where(np.arange(2000) < 40, truth, -1)
    draw = np.arange(2000)
    model = quality.cotrain([first, second], y, draw, 4, 0.9)
    alone = quality.cotrain([first, second], y, draw, 0, 0.9)
    right = [((m.score(first, second) >= 0.5) == truth)[40:].mean() for m in (model, alone)]
    assert right[0] >= 0.95 and right[0] >= right[1] - 0.01
    assert not np.allclose(model.text, alone.text)


def plain_text_view(text):
    """The text view by counting one pair, word and line after the other."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"", "-:;", "#", "$%", "&*", "|/\\"]
    body = text.encode()
    kind = [15 if b >= 128 else next((k for k, chars in enumerate(kinds) if chr(b) in chars), 14) for b in body]
    view = [0.0] * (16 * 16)
    for a, b in itertools.pairwise(kind):
        view[16 * a + b] += 1
    total = sum(view)
    view = [math.sqrt(v / total) if total else 0.0 for v in view]
    words, lines = body.split(), [x for x in body.split(b"\n") if x]
    new = 0
    for k in range(len(words)):
        new += words[k] not in words[k - k % 100:k]
    n = max(1, len(words))
    return [*view, new / n, len(set(lines)) / max(1, len(lines)), min(2.0, len(body) / n / 10), 1 / math.sqrt(n), min(1.0, len(lines) / n * 5)]


def test_text_view_equals_plain_counts():
    dice = random.Random(21)
    texts = ["", "a", "É", "a b\n\nC9 | x"] + ["".join(dice.choices("abzAZ09 \t\n.,!?'-#$&|/é\u4e2d{", k=dice.randrange(400))) for _ in range(60)] + ["word other " * 300]
    for text in texts:
        assert quality.text_view(text) == pytest.approx(plain_text_view(text), abs=1e-6)


def plain_cotrain(x, y, draw, rounds, sure):
    """Co-training one document at a time; the final chance of each row."""
    n = len(y)
    held = [y[i] >= 0 and draw[i] % 4 == 0 for i in range(n)]
    base = [y[i] >= 0 and not held[i] for i in range(n)]
    share = sum(y[i] for i in range(n) if base[i]) / sum(base)
    taught = [{i: y[i] for i in range(n) if base[i]} for _ in x]

    def fit(v, known):
        at = sorted(known)
        return quality.fit_logistic(v[at], np.array([float(known[i]) for i in at]), l2=0.3)

    def margin(w, row):
        return max(-30.0, min(30.0, float(row @ w[:-1] + w[-1])))

    for turn in range(rounds + 1):
        models = [fit(v, known) for v, known in zip(x, taught, strict=True)]
        if turn == rounds:
            break
        for me, peer in ((0, 1), (1, 0)):
            chance = {i: 1 / (1 + math.exp(-margin(models[me], x[me][i]))) for i in range(n) if y[i] < 0 and i not in taught[peer]}
            most = max(1, len(chance) // (2 * rounds))
            for label, part in ((1, share), (0, 1 - share)):
                surest = sorted(chance, key=lambda i: (-(chance[i] if label else 1 - chance[i]), i))[: max(1, int(most * part))]
                taught[peer] |= {i: label for i in surest if (chance[i] if label else 1 - chance[i]) >= sure}
    at = [i for i in range(n) if held[i]]
    truth = np.array([float(y[i]) for i in at])
    lines = [quality.fit_logistic(np.array([[margin(w, v[i])] for i in at]), truth, l2=0.01) for w, v in zip(models, x, strict=True)]
    views = [[a * margin(w, v[i]) + b for (a, b), w, v in zip(lines, models, x, strict=True)] for i in range(n)]
    mix = quality.fit_logistic(np.array([views[i] for i in at]), truth, l2=0.01)
    return [1 / (1 + math.exp(-(views[i][0] * mix[0] + views[i][1] * mix[1] + mix[2]))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cotraining_equals_a_plain_version(seed):
    dice = np.random.default_rng(seed)
    truth = dice.integers(0, 2, 240)
    x = [(dice.normal(size=(240, d)) + truth[:, None] * 1.2 * (np.arange(d) < 2)).astype(np.float32) for d in (6, 4)]
    y = np.where(dice.random(240) < 0.4, truth, -1)
    draw = dice.integers(0, 1000, 240)
    model = quality.cotrain(x, y, draw, 3, 0.9)
    assert model.score(*x) == pytest.approx(plain_cotrain(x, y, draw, 3, 0.9), abs=1e-4)


def test_repeated_ids_teach_once(spark, monkeypatch):
    dice = random.Random(8)
    rows = [(i, " ".join(dice.choices(["good", "text"] if i % 2 else ["bad", "junk"], k=30)), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0, "") for i in range(40)], LABELS)
    taught = []
    monkeypatch.setattr(quality, "cotrain", lambda x, y, draw, *rest: taught.append((y.tolist(), draw.tolist(), [v.tolist() for v in x])))
    quality.train(frame(spark, rows), labels, 40, 20)
    quality.train(frame(spark, [*rows, *rows[:1] * 500]), labels, 40, 20)
    assert len(taught[0][0]) == 60 and taught[0] == taught[1]


def test_full_licenses_with_titles_and_within_longer_texts(spark):
    known, full = dict(reversed(licenses.KNOWN)), {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    full |= {name: known[name] for name in ("MIT", "Zlib")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"} < set(full)
    names = sorted(full)
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + "\n\n".join(textwrap.fill(part, 70) for part in known["MIT"].split("\n\n"))
    starred = full["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    further = [mit, "A program.\n\n## Licence\n\n" + mit + "\n\nThanks\nto all.", "BSD 3-Clause License\n\n" + starred, "Licensed under the Apache License,\nVersion 2.0.", "x\n" + mit]
    rows = [(i, full[n], None) for i, n in enumerate(names)] + [(100 + i, t, None) for i, t in enumerate(further)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert [got[i].license_id for i in range(len(names))] == names
    assert [(got[100 + i].license_id, got[100 + i].statements) for i in range(5)] == [
        ("MIT", "MIT"), (None, "MIT"), ("BSD-3-Clause", "BSD-3-Clause"), ("Apache-2.0", ""), (None, "MIT")]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_wrapped_licenses_keep_their_lines_and_lose_their_notices(spark):
    notices = ("Copyright (c) 2020 A. Person", "(c) 1999-2001 A. Person", "Copyright © A. Person", "© A. Person", "Copyright A. Person", "Copyright 2020 A\nCopyright by B\nCopyright C Inc.",
               "Copyright The Authors\nAll rights reserved.", "Copyright (c) <year> <copyright holders>", "Copyright [yyyy] [name of copyright owner]", "# Copyright (C) A. Person", "Copyright" + " x" * 5000,
               "\n".join(["Copyright Holder Inc"[:10] + "Somebody"] * 5000))
    mit = dict(reversed(licenses.KNOWN))["MIT"]
    full = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    rows = [(i, f"ISC License\n\n{n}\n\n{ISC}", "ISC") for i, n in enumerate(notices)]
    rows += [(100 + w, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(textwrap.fill(p, w) for p in mit.split("\n\n")), "MIT") for w in range(40, 100)]
    rows += [(200 + w, "Copyright A. Person\n\n" + "\n\n".join(textwrap.fill(p, w) for p in full["BSD-3-Clause"].split("\n\n")), "BSD-3-Clause") for w in range(40, 100)]
    rows += [(300, full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Person"), "Apache-2.0")]
    rows += [(301, "\n\n".join(textwrap.fill(p, 60) for p in full["Apache-2.0"].split("\n\n")), "Apache-2.0")]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert got == {i: name for i, _, name in rows}


def test_licenses(spark):
    mit = dict(licenses.KNOWN)["Zlib"]
    text = "Copyright (c) 1999 A. Person\nAll rights reserved.\n\n" + mit.upper().replace("\n\n", "\n \t\n")
    rows = [(1, text, None), (2, "Prose.\n* Released under the MIT Licence!\nlicensed under cc by 4.0\nMore.", None), (3, None, None), (4, "", None), (5, "...", None),
            (6, text[:-30], None), (7, LONG, None), (7, LONG, None), (None, "released under the mit license", None), (8, "Copyright only", None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert len(got) == 9
    assert {i: (r.license_id, r.statements) for i, r in got.items()} == {
        1: ("Zlib", ""), 2: (None, "CC-BY-4.0,MIT"), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: (None, ""), 8: (None, ""), None: ("MIT", "MIT")}
    engine = duckdb.connect()
    engine.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    engine.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in rows])
    engine.execute(licenses.sql())
    names = [c[0] for c in engine.description]
    assert sorted(map(str, engine.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.values())
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA), licenses.known_licenses(spark)).count() == 0


def mixing_rows():
    dice = random.Random(6)
    vocabulary = {"x": "aa bb cc dd ee", "y": "ff gg hh ii jj", "z": "kk ll mm nn oo"}
    rows = []
    for i in range(300):
        domain = "xxxyyz"[i % 6]
        rows.append((i, " ".join(dice.choices(vocabulary[domain].split(), k=dice.randrange(1, 60))), domain))
    return rows


def test_mixing(spark):
    rows = mixing_rows()
    tests = [*rows, (900, None, None), (901, "", None), (902, "aa kk " * 20, None), (903, "aa bb ff", "other"), (None, "aa", "x"), (5, "zz", None)]
    docs = frame(spark, tests)
    targets = mixing.Targets({"x": 1.0, "y": 1.0, "z": 2.0}, budget=1.5)
    labelled = docs.select("text", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labelled, targets).collect()
    assert len(got) == len({i for i, _, _ in tests})
    total = sum(r.n_tokens for r in got)
    assert total == sum(len((t or "").split()) for _, t, _ in tests)
    assert all(r.rate >= 0 and math.isclose(r.p_x + r.p_y + r.p_z, 1) for r in got)
    for name, share in (("x", 0.25), ("y", 0.25), ("z", 0.5)):
        assert sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in got) == pytest.approx(share * 1.5 * total, rel=1e-3)
    by_id = {r.doc_id: r for r in got}
    assert min(by_id[902].p_x, by_id[902].p_z) > 1000 * by_id[902].p_y
    assert by_id[900].rate == by_id[901].rate == 1.5
    assert not any(word in str(mixing.posteriors(docs, mixing.train(labelled, targets), targets)._jdf.queryExecution().toString()) for word in ("Python", "Arrow", "Pandas"))


def test_rates_against_a_plain_solver(spark):
    """Targets out of reach: the fit is the least-squares one with rates at zero."""
    members = spark.createDataFrame([(1, 10, 1.0, 0.0), (2, 20, 0.5, 0.5), (3, 30, 0.1, 0.9)], "doc_id bigint, n_tokens bigint, p_a double, p_b double")
    got = [r.rate for r in mixing.fit_rates(members, mixing.Targets({"a": 0.0, "b": 1.0}), iterations=400).orderBy("doc_id").collect()]
    n, p = np.array([10.0, 20.0, 30.0]), np.array([[1, 0], [0.5, 0.5], [0.1, 0.9]])
    held, want = n @ p, np.array([0.0, 60.0])
    loss = lambda r: (((r * n) @ p - want) ** 2 / held).sum()
    best = np.ones(3)
    for _ in range(20_000):
        best = np.maximum(0, best - 0.5 * p @ (((best * n) @ p - want) / held))
    assert loss(np.array(got)) == pytest.approx(loss(best), rel=1e-2) and min(got) == 0.0


def test_rates_become_copies(spark):
    docs = frame(spark, [(i, f"t{i}", None) for i in range(1000)])
    rates = spark.createDataFrame([(i, 0.0 if i < 100 else 2.0 if i < 200 else 0.5) for i in range(1000)], "doc_id bigint, rate double")
    out = mixing.apply_rates(docs, rates)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert not any(i in n for i in range(100)) and all(n[i] == 2 for i in range(100, 200))
    assert 330 < sum(n.get(i, 0) for i in range(200, 1000)) < 470


def test_mixing_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    targets = mixing.Targets({"x": 1.0})
    assert mixing.mix(empty, empty.select("text", F.col("lang").alias("domain")), targets).count() == 0
    for bad in ({}, {"x": -1.0}, {"x": 0.0}):
        with pytest.raises(ValueError, match="targets"):
            mixing.Targets(bad)
