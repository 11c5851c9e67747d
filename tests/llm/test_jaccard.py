"""Linked documents and components against all pairs and a plain union-find."""

import random
import re

import numpy as np
import pytest

from pagemill.llm import jaccard
from pagemill.llm.components import components

SCHEMA = "doc_id bigint, text string, n string, rep string, tokens string, component string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(parts)


def plain_set(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_components(rows, percent=80):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, len(s)): find(i) for i, s in sets}


def got(df):
    return {(r.doc_id, r.n_shingles): r.component_id for r in df.collect()}


def near_copies(dice, n_base, copies):
    """Texts around common ones: edits at chosen places, appended and cut words, a passage that many share."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(dice.choices(vocabulary, k=40))
    rows, i = [], 0
    for _ in range(n_base):
        words = dice.choices(vocabulary, k=dice.choice([1, 3, 5, 8, 12, 30, 60, 150, 300]))
        if dice.random() < 0.4:
            words = [*words, *passage.split()]
        for _ in range(dice.randrange(1, copies)):
            edited = words.copy()
            for _ in range(dice.choice([0, 0, 1, 2, 3, 6])):
                edited[dice.randrange(len(edited))] = dice.choice(vocabulary)
            if dice.random() < 0.3:
                edited = [*edited[: len(edited) * 9 // 10], *dice.choices(vocabulary, k=2)]
            sep = dice.choice([" ", "\n", "\t ", "\x0b"])
            rows.append((i := i + dice.randrange(1, 9), sep.join(w.upper() if dice.random() < 0.1 else w for w in edited)))
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed):
    rows = near_copies(random.Random(seed), 60, 9)
    assert got(jaccard.link_components(frame(spark, rows))) == plain_components(rows)


def test_one_large_group_around_the_threshold(spark):
    """Copies whose sets differ so much that many pairs of the group are not linked."""
    dice = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = base.copy()
        for at in dice.sample(range(100), dice.choice([1, 2, 3])):
            words[at] = f"x{i}_{at}"
        rows.append((1000 - i, " ".join(words)))
    assert got(jaccard.link_components(frame(spark, rows))) == plain_components(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é É"), (8, "É É"), (9, long), (10, long + " end"), (11, "a b c d e"),
            (12, "a b c d e"), (12, "a b c d e"), (13, "a\xa0b"), (14, "a b c d e f"), (15, "A\x0bB\x0cC d e")]
    assert got(jaccard.link_components(frame(spark, rows))) == plain_components(rows)
    nulls = got(jaccard.link_components(frame(spark, [(None, "a b c d e"), (3, "a b c d e"), (None, None)])))
    assert nulls == {(None, 1): None, (3, 1): 3, (None, 0): None}
    assert jaccard.link_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_any_size_agree(spark):
    rows = near_copies(random.Random(5), 25, 6)
    want = plain_components(rows)
    sets = [(i, s) for (i, _), s in zip(rows, jaccard.shingle_sets([t.encode() for _, t in rows], 5), strict=True)]
    assert [len(s) for _, s in sets] == [len(plain_set(t)) for _, t in rows]
    assert got(jaccard.link_components(frame(spark, rows, 2), block_docs=7)) == want


def test_an_id_with_several_texts_is_one_node(spark):
    a, b, c = ("a b c d e f g h", "other words that nobody else has here", "x y z u v w t s")
    rows = [(3, a), (5, a), (5, b), (5, ""), (8, b), (9, c), (1, c), (9, None), (20, "lone text of more than five words"), (20, "and another lone text by the same id"), (30, "q")]
    want = want_of(rows)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect()}
    assert found == {(i, len(plain_set(t)), want[i]) for i, t in rows}
    kept = [sorted((r.doc_id, r.text) for r in jaccard.drop_linked(frame(spark, rows, parts)).collect()) for parts in (1, 4)]
    assert [i for i, _ in kept[0]] == [1, 3, 20, 30] and kept[0] == kept[1]


def want_of(rows):
    """Components over ids: links by similarity, and all texts of an id together."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, t) in enumerate(rows):
        for j, u in rows[k + 1:]:
            a, b = plain_set(t), plain_set(u)
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows_with_repeated_ids(spark, seed):
    dice = random.Random(seed)
    texts = [t for _, t in near_copies(dice, 25, 5)]
    rows = [(dice.randrange(60), t) for t in texts]
    want = want_of(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect()} == {(i, len(plain_set(t)), want[i]) for i, t in rows}
    assert sorted(r.doc_id for r in jaccard.drop_linked(frame(spark, rows)).collect()) == sorted(set(want.values()))


def test_hashes_follow_the_words():
    dice = random.Random(3)
    texts = [" ".join(dice.choices(["a", "bb", "ccc", "É"], k=dice.randrange(0, 40))) for _ in range(200)]
    seen = {}
    for text, one in zip(texts, jaccard.shingle_sets([t.encode() for t in texts], 5), strict=True):
        again = jaccard.shingle_sets([("  " + text.upper().replace("É", "É") + "\n").encode()], 5)[0]
        assert np.array_equal(one, again)
        assert seen.setdefault(plain_set(text), one.tobytes()) == one.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_first_of_each_component_stays(spark):
    rows = [*near_copies(random.Random(11), 20, 5), (9000, None), (9001, "")]
    extra = [(None, "a b c d e"), (None, "a b c d e"), (None, "other"), (9001, "")]
    out = jaccard.drop_linked(frame(spark, [*rows, *extra]))
    assert out.columns == frame(spark, rows[:1]).columns
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(plain_components(rows).values()))
    assert sorted(r.text for r in got if r.doc_id is None) == ["a b c d e", "other"]


def test_chains_stars_and_loops(spark):
    dice = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)] + [(1100, 1099)]
    links = [*chain, *star, (5, 5), (7, 1000), (1000, 7), (40, 30), (30, 20), (40, 20)]
    dice.shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1101)]} | {20: 20, 30: 20, 40: 20}
    assert found == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
