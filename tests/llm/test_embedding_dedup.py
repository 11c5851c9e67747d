"""Linked vectors against all pairs."""

import numpy as np
import pytest

from pagemill.llm.embedding_dedup import code_product, link_vectors, quantise

SCHEMA = "vec_id bigint, embedding array<double>, node string, rep string, k1 int, dim int"


def brute(rows):
    vectors = {}
    for i, v in rows:
        good = i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
        vectors[i, None if v is None else tuple(v)] = np.array(v, dtype=float) if good else None
    keys = list(vectors)
    scaled = {k: None if x is None else np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for k, x in vectors.items()}
    links = {k: set() for k in keys}
    for a in keys:
        for b in keys:
            x, y = scaled[a], scaled[b]
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.9:
                links[a].add(b)
    label = {k: k[0] for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in [*links[a], *(k for k in keys if a[0] is not None and k[0] == a[0])]:
                if label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted(((i, len(links[i, v]), label[i, v], i is not None and label[i, v] == i) for i, v in keys), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in link_vectors(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        if i % 4 == 0:
            rows.append((1000 - i, rng.normal(size=24).tolist()))
        else:  # around the threshold, and chains of such
            near = np.array(rows[-1][1])
            rows.append((1000 - i, (near + rng.normal(size=24) * np.linalg.norm(near) / np.sqrt(24) * rng.uniform(0.3, 0.6)).tolist()))
    return rows


def test_all_pairs_over_several_tiles(spark, clusters):
    assert run(spark, clusters, tile=37) == brute(clusters)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0, 0.0]),
            (6, [float("nan"), 1.0, 0.0, 0.0]), (7, [float("inf"), 1.0, 0.0, 0.0]), (8, [1.0, 0.0]), (9, [3.0, 0.1]), (10, []), (None, [1.0, 0.0]),
            (11, [1e300, 0.0, 0.0, 0.0]), (12, [1e-300, 1e-302, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (13, [-1.0, 0.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert (2, 3, 1, False) in run(spark, rows)  # a cosine of 0.9 counts


def test_an_id_with_two_vectors_joins_both(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.01]), (5, [0.0, 1.0]), (9, [0.01, 1.0]), (7, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows) == sorted([(5, 1, 3, False), (3, 1, 3, True), (5, 1, 3, False), (9, 1, 3, False), (7, 0, 7, True)], key=str)


def test_a_hot_vector_and_a_hot_group(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, centre.tolist()) for i in range(0, 400, 2)] + [(i, (centre + rng.normal(size=16) * 0.02).tolist()) for i in range(1, 200, 2)]
    assert run(spark, rows, tile=30) == sorted(((i, 299, 0, i == 0) for i, _ in rows), key=str)


def test_no_rows(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_the_bound_holds_and_the_product_is_exact(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_t(2, size=(40, dim))
    codes, step, length, lost = quantise(x)
    assert (code_product(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    bound = length[:, None] * lost + lost[:, None] * (length + lost)
    assert (np.abs(unit @ unit.T - code_product(codes, codes) * step[:, None] * step) <= bound).all()
