"""Graph search against brute force, pruning against its definition, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import neighbours
from pagemill.llm.catalog import op10_nearest_neighbours

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, dim string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, asked, k):
    """Exact neighbours by plain loops over all rows."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i in asked:
            pairs = {(-float(v @ q), j) for j, v in good if j != i and len(v) == len(q)}
            out[i] = [(j, -s) for s, j in sorted(pairs)[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in v] for q, v in out.items()}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0, None]), (8, [nan, 1.0]),
            (9, [inf, 1.0]), (10, [1.0, 1.0, 1.0]), (11, [-1.0, 0.5]), (None, [1.0, 1.0]), (12, []), (13, [1e-30, 0.0])]
    got = answers(neighbours.search(frame(spark, rows), frame(spark, rows), k=4, shard_size=3))
    want = brute(rows, {i for i, _ in rows}, 4)
    want.pop(10)  # no candidate of its dimension
    assert got == want


def test_many_copies_of_one_vector(spark):
    dice = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(100, 0, -1)] + [(200 + i, dice.normal(size=3).tolist()) for i in range(50)]
    got = answers(neighbours.search(frame(spark, rows), frame(spark, rows[::10]), k=20, shard_size=40))
    assert got == brute(rows, {i for i, _ in rows[::10]}, 20)


def test_recall(spark):
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(10, 24))
    x = centres[dice.integers(0, 10, 3000)] + dice.normal(size=(3000, 24)) * 0.7
    x *= dice.uniform(0.5, 2, size=(3000, 1))  # lengths differ
    rows = list(enumerate(x.tolist()))
    got = answers(neighbours.search(frame(spark, rows), frame(spark, rows).filter("vec_id % 20 = 0"), shard_size=1000))
    want = brute(rows, set(range(0, 3000, 20)), 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    assert all(abs(s - x[q] @ x[i]) < 1e-9 for q, found in got.items() for i, s in found)


@pytest.mark.parametrize("stretch", [{7: 1e4}, {7: 1e6, 8: 1e6, 9: 1e-6}, {None: 1e25}, {None: 1e-25, 5: 1e-20}, {k: 1000.0 for k in range(0, 1500, 3)}])
def test_recall_with_lengths_far_apart(spark, stretch):
    """Unit vectors, of which some (None: all) are stretched; full lists in any case."""
    dice = np.random.default_rng(4)
    x = dice.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k, factor in stretch.items():
        x[slice(None) if k is None else k] *= factor
    rows = list(enumerate(x.tolist()))
    got = answers(neighbours.search(frame(spark, rows), frame(spark, rows).filter("vec_id % 20 = 0"), shard_size=800))
    want = brute(rows, set(range(0, 1500, 20)), 20)
    assert all(len(found) == 20 for found in got.values()) and got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_a_graph_that_came_apart_is_scanned(spark):
    dice = np.random.default_rng(6)
    rows = list(enumerate(dice.normal(size=(300, 8)).tolist()))
    df = frame(spark, rows)
    graphs = neighbours.build_graphs(df, 20, 100, 8, 16, 1.2)
    got = answers(neighbours.nearest(df.filter("vec_id % 20 = 0"), graphs.withColumn("edges", F.expr("unhex(repeat('ff', length(edges)))")), 20, 8, 32))
    assert got == brute(rows, set(range(0, 300, 20)), 20)


def test_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = answers(op10_nearest_neighbours(spark, folder))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.98 * 20 * len(want)


def test_pruning_by_definition():
    dice = np.random.default_rng(3)
    x = neighbours.on_sphere(dice.normal(size=(60, 5)))
    candidates = np.stack([dice.permutation(60)[:25] for _ in range(8)])
    candidates[:, 3] = candidates[:, 4]
    candidates[:, 7] = -1
    got = neighbours.robust_prune(x, np.arange(8), candidates, 6, 1.2)
    distance = lambda a, b: float(np.linalg.norm(x[a].astype(float) - x[b].astype(float)))
    for node in range(8):
        left, kept = {int(c) for c in candidates[node] if c >= 0 and c != node}, []
        while left and len(kept) < 6:
            best = min(left, key=lambda c: distance(node, c))
            kept.append(best)
            left = {c for c in left if c != best and 1.2 * distance(best, c) > distance(node, c)}
        assert [c for c in got[node].tolist() if c >= 0] == kept


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.search(empty, empty).count() == 0
