"""Near-duplicate vectors by cosine: int8 tile products with error bounds, exact only where they leave a doubt.

1. Equal vectors are one node that counts its copies. Nodes are numbered and cut into
   tiles; a tile is one row that holds, for each node, the unit vector in int8 steps of
   its own size, the length of what these steps lose (the quantisation error), and the
   vector itself.
2. Every two tiles of one dimension meet once. The product of their int8 codes is exact
   (whole numbers in float32, in parts of at most 1,040 components). With ``x = q + dx``
   and ``y = r + dy`` the cosine is within ``|q||dy| + |dx||r| + |dx||dy|`` of the product
   of the codes, so a pair whose product plus that bound stays below the threshold is
   settled. All others are computed in double precision from the vectors.
3. A pair of tiles yields no pairs of nodes: for each node the number of vectors linked,
   and a spanning forest of the links. Forests of all tile pairs give the components.

The work grows with the square of the number of different vectors; memory and the
exchange grow with that number times the number of tiles, which is as small as a task's
memory allows (``tile`` nodes).

Defined results: a vector that is null, zero, or holds null or non-finite components
links with nothing. Vectors of different dimension do not link. Rows that repeat id and
vector are one vector. Different vectors of one id count their own links and share a
component. A row without an id counts as a vector for nobody and gives a null component
and kept false. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import partitions, settle
from pagemill.llm.components import components
from pagemill.operators.sizing import global_rank

#: Products of int8 codes below 2**24 are whole in float32: 1,040 * 127 * 127 < 2**24.
_EXACT_PART = 1040
_SLACK = 1e-6  # above the rounding of all float32 steps that compare a product with the threshold
_SIDE = 1024


def power_scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component lies in [0.5, 1): no bit of a normal number is lost."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their step, the length of code times step, and an upper bound of the error's length."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    near = codes * step[:, None]
    lost = np.sqrt(np.einsum("ij,ij->i", unit - near, unit - near))
    return codes.astype(np.int8), step, np.sqrt(np.einsum("ij,ij->i", near, near)), lost + 1e-12


def code_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of all rows of two int8 matrices, exact up to 1,040 components and to float64 beyond."""
    if a.shape[1] <= _EXACT_PART:
        return a.astype(np.float32) @ b.astype(np.float32).T
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT_PART):
        total += a[:, k:k + _EXACT_PART].astype(np.float32) @ b[:, k:k + _EXACT_PART].astype(np.float32).T
    return total


class Tile:
    """What a row of packed tiles holds."""

    def __init__(self, row: dict) -> None:
        dim = row["dim"]
        self.nodes, self.copies = np.frombuffer(row["nodes"], dtype=np.int64), np.frombuffer(row["copies"], dtype=np.int64)
        self.codes = np.frombuffer(row["codes"], dtype=np.int8).reshape(-1, dim)
        self.step, self.length, self.lost = np.frombuffer(row["bounds"], dtype=np.float64).reshape(3, -1)
        kind = np.float32 if row["narrow"] else np.float64
        self.x = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, dim)

    def exact(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.x[at].astype(np.float64)
        return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def doubtful(one: Tile, two: Tile, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in both tiles, of the blocks that start at i and j, whose cosine may reach the threshold."""
    a, b = slice(i, i + _SIDE), slice(j, j + _SIDE)
    product = code_product(one.codes[a], two.codes[b])
    most = one.length[a].max() * two.lost[b].max() + one.lost[a].max() * (two.length[b].max() + two.lost[b].max())
    step = one.step[a].astype(product.dtype)
    least = ((threshold - most - _SLACK) / two.step[b]).astype(product.dtype)
    p, q = np.nonzero(product * step[:, None] >= least[None, :])
    near = product[p, q].astype(np.float64) * one.step[a][p] * two.step[b][q]
    bound = one.length[a][p] * two.lost[b][q] + one.lost[a][p] * (two.length[b][q] + two.lost[b][q])
    open_ = near + bound + _SLACK >= threshold
    return p[open_] + i, q[open_] + j


def reaching(one: Tile, two: Tile, p: np.ndarray, q: np.ndarray, threshold: float, most: int = 65_536) -> np.ndarray:
    """Which of the pairs have a cosine of at least the threshold, in double precision."""
    found = np.empty(len(p), dtype=bool)
    for k in range(0, len(p), most):
        (x, nx), (y, ny) = one.exact(p[k:k + most]), two.exact(q[k:k + most])
        found[k:k + most] = np.einsum("ij,ij->i", x, y) / (nx * ny) >= threshold
    return found


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each node's is one of its component, its own at first) after joining u[k] with v[k]."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


_PACKED = "dim int, tile bigint, nodes binary, copies binary, codes binary, bounds binary, narrow boolean, vectors binary"
_FOUND = "node bigint, other bigint, links bigint"
_FOUND_ARROW = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("embedding").chunks]).astype(np.float64).reshape(-1, dim)
    x = power_scaled(x)
    codes, step, length, lost = quantise(x)
    narrow = bool((x.astype(np.float32) == x).all())
    row = {
        "dim": dim, "tile": key[1].as_py(), "nodes": group.column("node").to_numpy().tobytes(), "copies": group.column("copies").to_numpy().tobytes(),
        "codes": codes.tobytes(), "bounds": np.concatenate([step, length, lost]).tobytes(), "narrow": narrow,
        "vectors": x.astype(np.float32 if narrow else np.float64).tobytes(),
    }
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary())
    return pa.Table.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def _meet(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """For two tiles (or one with itself): the links of each node, and a forest of them."""
        tiles = [Tile(r) for r in group.sort_by("tile").to_pylist()]
        one, two = tiles[0], tiles[-1]
        alone = len(tiles) == 1
        first = 0 if alone else len(one.nodes)  # where the second tile's nodes stand among all
        nodes = one.nodes if alone else np.concatenate((one.nodes, two.nodes))
        links, label = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
        for i in range(0, len(one.nodes), _SIDE):
            for j in range(i if alone else 0, len(two.nodes), _SIDE):
                p, q = doubtful(one, two, i, j, threshold)
                if alone and i == j:
                    p, q = p[p < q], q[p < q]
                linked = reaching(one, two, p, q, threshold)
                p, q = p[linked], q[linked]
                np.add.at(links, p, two.copies[q])
                np.add.at(links, q + first, one.copies[p])
                label = join_labels(label, p, q + first)
        at = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]]), pa.array(links[at])], schema=_FOUND_ARROW)

    return run


def _is_usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id (the least vec_id that links reach), kept: one row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", _is_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    # Two hashes name a vector; ids without a usable one keep them apart, too.
    named = rows.withColumns({"k1": F.xxhash64(F.lit(1), "embedding"), "k2": F.xxhash64(F.lit(2), "embedding")})
    distinct = settle(named.groupBy("vec_id", "k1", "k2").agg(F.any_value("usable").alias("usable")), "vectors")
    sized = named.filter("usable").withColumn("dim", F.size("embedding"))
    kinds = sized.groupBy("dim", "k1", "k2").agg(F.any_value("embedding").alias("embedding"))
    counted = distinct.filter("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = settle(global_rank(kinds.join(counted, ["k1", "k2"]), "dim", "k1", "k2", name="node"), "nodes")

    total, widest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    # At most ``tile`` nodes and 64 MB of doubles; smaller ones where few would leave tasks without work.
    most = max(1, min(tile, (8 << 20) // widest))
    wanted = max(-(-total // most), int((2 * partitions(spark)) ** 0.5), 1)
    size = max(1, -(-total // wanted))
    packed = nodes.withColumn("tile", F.floor(F.col("node") / size).cast("bigint")).select("dim", "tile", "node", "copies", "embedding")
    packed = settle(packed.groupBy("dim", "tile").applyInArrow(_pack, _PACKED), "tiles")
    ends = packed.groupBy("dim").agg(F.min("tile").alias("low"), F.max("tile").alias("high"))
    few = ends.limit(10_001).count() <= 10_000  # dimensions; one of them may hold all tiles
    placed = packed.join(F.broadcast(ends) if few else ends, "dim")
    partner = placed.withColumn("with", F.explode(F.sequence("low", "high"))).drop("low", "high")
    pairs = partner.withColumns({"i": F.least("tile", "with"), "j": F.greatest("tile", "with")}).drop("with")
    found = settle(pairs.groupBy("dim", "i", "j").applyInArrow(_meet(threshold), _FOUND), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named_nodes = settle(nodes.select("node", "k1", "k2", "rep", "copies").join(links, "node", "left"), "named")
    mine = distinct.filter("usable").join(named_nodes, ["k1", "k2"])
    same_id = mine.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id", "u")
    same_id = mine.select("vec_id", F.col("node").alias("v")).join(same_id, "vec_id").select("u", "v")
    joined = found.filter("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v")).unionByName(same_id)
    parts = settle(components(joined), "parts")
    of_node = named_nodes.select("node", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = settle(of_node.join(least, "component").select("node", "component_id"), "least")

    mine = mine.join(of_node, "node").select("vec_id", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    by_id = mine.groupBy("vec_id").agg(F.min("component_id").alias("of_id"))
    out = distinct.join(mine.drop("component_id"), ["vec_id", "k1", "k2"], "left").join(by_id, "vec_id", "left")
    component = F.coalesce("of_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


#: For DuckDB, which joins all pairs: equal results on small tables.
SQL = """
WITH RECURSIVE vectors AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
  SELECT vec_id, v FROM vectors
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM vectors WHERE vec_id IS NOT NULL
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM vectors LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
