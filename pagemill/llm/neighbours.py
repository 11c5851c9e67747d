"""Nearest neighbours by inner product over robust-pruned directed graphs, one graph per shard.

Equal vectors are one node that lists its smallest ids. Nodes are dealt to shards by
length class (a factor of two) and hash; the number of shards of a class follows the
number of its nodes. In each shard the nodes are inserted in random order: a greedy
beam search over the graph so far proposes neighbours, relaxed distance pruning keeps
those that no kept one dominates (closer to it by the factor ``alpha``), and reverse
edges are pruned the same way. Inner products become distances by one more coordinate
that gives all nodes of a shard the same length; since lengths within a shard are alike
and scaled to about one, single precision is enough for that. Queries go to every shard
in blocks; a beam search finds candidates, and where it reaches too few because a graph
has come apart, the shard is scanned. Inner products are then computed in double
precision on the original vectors.

Every query meets every shard, so work grows with queries times shards. Shards and
blocks grow with the table up to what a task can hold (``held`` bytes); beyond, the work
is quadratic where queries are a fixed share of the rows.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, neither as queries nor as candidates, nor do null ids. Vectors of another
dimension than the query's are no candidates. A row that repeats id and vector counts
once. Ties go to the smaller id. Fewer candidates than ``k`` are all returned. An empty
table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import bind
from pagemill.llm.common import partitions, settle


def beam_search(
    x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """(queries, beam) nodes, best first, and their inner products; -1 where fewer were reached.

    All queries advance together: each expands its ``width`` best nodes not expanded yet,
    until none is left within its beam.
    """
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # stands for a missing edge
    nodes = np.full((q, beam), -1, dtype=np.int64)
    near = np.full((q, beam), -np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    nodes[:, 0], near[:, 0], done[:, 0] = entry, queries @ x[entry], False
    seen[:, entry] = True
    live = np.arange(q)
    while len(live):
        rank = np.where(done[live], np.inf, np.arange(beam, dtype=np.float32))
        pick = np.argpartition(rank, min(width, beam - 1), axis=1)[:, :width]
        chosen = np.where(np.take_along_axis(done[live], pick, axis=1), -1, np.take_along_axis(nodes[live], pick, axis=1))
        done[live[:, None], pick] = True
        fresh = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(live), -1)
        fresh = np.sort(np.where(fresh < 0, n, fresh), axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[live[:, None], fresh]] = n
        seen[live[:, None], fresh] = True
        fresh = np.sort(fresh, axis=1)
        fresh = fresh[:, : max(1, int((fresh < n).sum(axis=1).max()))]
        real = fresh < n
        score = np.full(fresh.shape, -np.inf, dtype=np.float32)
        at = np.nonzero(real)
        score[at] = np.einsum("ij,ij->i", queries[live[at[0]]], x[fresh[at]])
        all_near = np.concatenate((near[live], score), axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(all_near, order, axis=1)
        nodes[live] = np.take_along_axis(np.concatenate((nodes[live], np.where(real, fresh, -1)), axis=1), order, axis=1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~real), axis=1), order, axis=1)
        live = live[~done[live].all(axis=1)]
    return nodes, near


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(nodes, degree) neighbours, -1 where fewer: each kept one removes what is ``alpha`` times closer to it than to the node."""
    sphere = 2 * float(np.einsum("i,i->", x[0], x[0]))  # all nodes have this length
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    ordered = np.sort(candidates, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    points = x[ordered]
    apart = sphere - 2 * np.einsum("ij,ikj->ik", x[nodes], points)
    apart = np.where(ordered < 0, np.inf, np.maximum(apart, 0))
    order = np.argsort(apart, axis=1, kind="stable")
    ordered, apart = np.take_along_axis(ordered, order, axis=1), np.take_along_axis(apart, order, axis=1)
    points = np.take_along_axis(points, order[:, :, None], axis=1)
    between = np.maximum(sphere - 2 * np.matmul(points, points.transpose(0, 2, 1)), 0)
    alive, kept, rows = ordered >= 0, np.full((len(nodes), degree), -1, dtype=np.int64), np.arange(len(nodes))
    for k in range(degree):
        best = alive.argmax(axis=1)
        any_left = alive[rows, best]
        if not any_left.any():
            break
        kept[:, k] = np.where(any_left, ordered[rows, best], -1)
        alive &= ~((alpha * alpha * between[rows, best] <= apart) & any_left[:, None])
        alive[rows, best] = False
    return kept


@dataclass(frozen=True)
class Graph:
    """Nodes on a sphere (one coordinate more than the vectors), their edges, and where searches start."""

    x: np.ndarray
    edges: np.ndarray
    entry: int


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all have the length of the longest; order by inner product stays order by distance."""
    squares = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]]).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """All vectors times one power of two, so that the largest component is about one."""
    return np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max())[1]))


def build(vectors: np.ndarray, degree: int, beam: int, alpha: float) -> Graph:
    """Insert all vectors into a graph of at most ``degree`` edges per node."""
    x = on_sphere(scaled(vectors))
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int64)
    counts = np.zeros(n, dtype=np.int64)
    order = np.random.default_rng(n).permutation(n)
    middle = x.mean(axis=0)
    entry = int((x @ middle).argmax())
    order = np.concatenate(([entry], order[order != entry]))
    at = 1
    while at < n:
        new = order[at:at + min(256, max(1, at))]
        at += len(new)
        found, _ = beam_search(x, edges, entry, x[new], beam)
        keep = robust_prune(x, new, found, degree, alpha)
        edges[new] = keep
        counts[new] = (keep >= 0).sum(axis=1)
        source, target = np.repeat(new, degree)[keep.ravel() >= 0], keep[keep >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        owners, first, many = np.unique(target, return_index=True, return_counts=True)
        room = counts[owners] + many <= degree
        for node, start, size in zip(owners[room].tolist(), first[room].tolist(), many[room].tolist(), strict=True):
            edges[node, counts[node]:counts[node] + size] = source[start:start + size]
            counts[node] += size
        full, first, many = owners[~room], first[~room], many[~room]
        if len(full):
            wide = np.full((len(full), int(many.max())), -1, dtype=np.int64)
            slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide[np.repeat(np.arange(len(full)), many), slot] = source[np.repeat(first, many) + slot]
            wide = np.concatenate((edges[full], wide), axis=1)
            if wide.shape[1] > beam:  # the nearest ones, as a search would propose
                near = np.where(wide >= 0, np.einsum("ij,ikj->ik", x[full], x[wide]), -np.inf)
                wide = np.take_along_axis(wide, np.argpartition(-near, beam - 1, axis=1)[:, :beam], axis=1)
            edges[full] = robust_prune(x, full, wide, degree, alpha)
            counts[full] = (edges[full] >= 0).sum(axis=1)
            edges[full] = np.take_along_axis(edges[full], np.argsort(edges[full] < 0, axis=1, kind="stable"), axis=1)
    return Graph(x, edges, entry)


def _matrix(column: pa.ChunkedArray, dim: int, dtype: type) -> np.ndarray:
    """The rows of a list column of known length; float64 holds doubles as they are."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(dtype).reshape(-1, dim)


_GRAPH = "dim int, shard int, block int, vectors binary, edges binary, entry bigint, ids binary, starts binary"


def _usable(vectors: DataFrame) -> DataFrame:
    one = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return one.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)).withColumn("dim", F.size("embedding"))


def build_graphs(vectors: DataFrame, k: int, shard_size: int, degree: int, beam: int, alpha: float, held: int = 64 << 20) -> DataFrame:
    """One row per shard: its vectors, edges and ids (for equal vectors, the ``k`` + 1 smallest)."""
    same = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    few = _usable(vectors).withColumn("_place", F.dense_rank().over(same)).filter(F.col("_place") <= k + 1)
    nodes = few.groupBy("dim", "embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    # Lengths by powers of two, from the largest component so that squares cannot overflow.
    length = bind(
        F.array_max(F.transform("embedding", F.abs)),
        lambda most: F.log2(most) + F.log2(F.aggregate(F.transform("embedding", lambda v: v / most), F.lit(0.0), lambda s, v: s + v * v)) / 2,
    )
    nodes = settle(nodes.withColumn("class", F.floor(length + 0.5).cast("int")), "nodes")
    total, widest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    shard_size = max(1, min(held // (8 * widest + 8 * degree), max(shard_size, total // (2 * partitions(vectors.sparkSession)))))
    sizes = nodes.groupBy("dim", "class").agg(F.ceil(F.count(F.lit(1)) / shard_size).cast("bigint").alias("shards"))
    # Shards of a dimension are numbered through, class by class.
    before = Window.partitionBy("dim").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("shards").over(before), F.lit(0)))
    nodes = nodes.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, ["dim", "class"])
    nodes = nodes.withColumn("shard", (F.pmod(F.xxhash64("embedding"), F.col("shards")) + F.col("start")).cast("int"))

    def graph(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        exact = _matrix(group.column("embedding"), dim, np.float64)
        made = build(exact, degree, beam, alpha)
        lists = group.column("ids").to_pylist()
        starts = np.concatenate(([0], np.cumsum([len(i) for i in lists]))).astype(np.int64)
        row = {
            "dim": key[0].as_py(), "shard": key[1].as_py(), "block": 0, "vectors": exact.tobytes(), "edges": made.edges.astype(np.int32).tobytes(),
            "entry": made.entry, "ids": np.concatenate(lists).astype(np.int64).tobytes(), "starts": starts.tobytes(),
        }
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    made = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    return settle(_apart(nodes, made, "dim", "shard").groupBy("dim", "shard").applyInArrow(graph, _GRAPH), "graphs")


def _apart(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows hashed by their group into more partitions than there are groups, so that few groups do not share a task."""
    return df.repartition(max(partitions(df.sparkSession), min(4 * groups, 1024)), *keys)


def nearest(
    queries: DataFrame, graphs: DataFrame, k: int, degree: int, beam: int, block_size: int = 1024, held: int = 64 << 20
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query's vector, other ids than its own."""
    asked = settle(_usable(queries).distinct(), "queries")
    total, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    block_size = min(held // (16 * widest), max(block_size, total // (2 * partitions(queries.sparkSession))))
    blocks = max(1, -(-total // block_size))
    places = graphs.select("dim", F.col("shard").alias("_place"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(places, "dim").withColumnRenamed("_place", "shard")
    spread = graphs.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dim, ids = key[0].as_py(), left.column("vec_id").to_numpy()
            wanted = _matrix(left.column("embedding"), dim, np.float64)
            held = {c: right.column(c)[0].as_py() for c in right.column_names}
            exact = np.frombuffer(held["vectors"], dtype=np.float64).reshape(-1, dim)
            edges = np.frombuffer(held["edges"], dtype=np.int32).reshape(len(exact), degree).astype(np.int64)
            owners, starts = np.frombuffer(held["ids"], dtype=np.int64), np.frombuffer(held["starts"], dtype=np.int64)
            x = on_sphere(scaled(exact))
            flat = np.hstack([wanted, np.zeros((len(wanted), 1))])
            # The order by inner product ignores the query's length, which float32 may not hold.
            flat = (flat / np.abs(flat).max(axis=1, keepdims=True)).astype(np.float32)
            for start in range(0, len(flat), 256):
                found, _ = beam_search(x, edges, held["entry"], flat[start:start + 256], beam)
                for q in range(len(found)):
                    at = found[q][found[q] >= 0]
                    if len(at) < min(k + 1, len(exact)):
                        at = np.arange(len(exact))
                    score = exact[at] @ wanted[start + q]
                    best = at[np.argsort(-score, kind="stable")[: k + 1]]
                    own = int(ids[start + q])
                    pairs = [(-float(exact[b] @ wanted[start + q]), int(i)) for b in best for i in owners[starts[b]:starts[b + 1]] if i != own]
                    rows += [(own, i, -s) for s, i in sorted(pairs)[:k]]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    keys = ("dim", "shard", "block")
    groups = blocks * graphs.count()
    dealt, spread = _apart(dealt, groups, *keys), _apart(spread, groups, *keys)
    found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_size: int = 8192, degree: int = 48, beam: int = 96, alpha: float = 1.2,
    search_beam: int = 256,
) -> DataFrame:
    graphs = build_graphs(vectors, k, shard_size, degree, beam, alpha)
    return nearest(queries, graphs, k, degree, max(search_beam, k + 2))
