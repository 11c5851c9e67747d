"""The prefix trie of conversations: double arrays per shard, merged where shards share nodes.

1. Conversations are rebuilt turn by turn (``rebuild``). A turn is named by two hashes
   of role and text; a sequence of turns by the exclusive-or of hashes of (turn, place),
   so that any part of a conversation adds to its name by itself.
2. Turns meet in chunks of at most ``CHUNK`` per conversation, however long it is. Equal
   chunks below equal prefixes are one path that counts its conversations. Paths are
   sorted and cut into ranges of like size: prefix shards.
3. A shard gives its turns dense numbers and packs its trie into BASE and CHECK: node s
   has a child by turn c iff ``CHECK[BASE[s] + c] == s``. Traversing all paths through
   the arrays, level by level, sums up the nodes.
4. As shards are ranges, a node can lie in several only on the first or the last path of
   a shard, or above a chunk that goes on. These upper nodes carry what lies below them
   in one shard alone, are merged by name, and pass their sums up by pointer doubling.

Defined results: rows without conv_id are left out. Rows of a conversation with equal
turn come by role, then by the hashes of role and text. Repeated rows are turns of
their own. A null turn is first; null role or text is empty. An empty table gives no
rows, not even a root. ``conv_id % 100`` has the sign of conv_id. Only conv_id, turn, role
and text are read. The conversations that end in one node are hashed in one task, which
reads them as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import partitions, settle
from pagemill.operators.sizing import global_rank

CHUNK = 4096
_NOBODY = np.iinfo(np.int64).max


class DoubleArray:
    """BASE and CHECK of a trie; state 0 is its root, symbols are numbers from 1."""

    def __init__(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Node k + 1 is the child of node ``parents[k]`` by ``symbols[k]``; parents come before children."""
        n = len(parents) + 1
        by = np.lexsort((symbols, parents))
        owners, first, many = np.unique(parents[by], return_index=True, return_counts=True)
        room = n + int(symbols.max(initial=0)) + 2
        self._used = np.zeros(2 * room, dtype=bool)
        self._used[0] = True
        base, slot = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self._free, self._hint, self._end = 1, 0, 1
        # Wide nodes first; single children then fill the holes that they leave.
        for k in np.argsort(-many, kind="stable").tolist():
            children = by[first[k]:first[k] + many[k]]
            own = symbols[children]
            start = self._place(own)
            base[owners[k]] = start
            slot[children + 1] = start + own
        size = self._end
        self.base, self.check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parents]
        del self._used

    def _place(self, own: np.ndarray, tries: int = 32) -> int:
        """A base at which the slots of all ``own`` symbols are free; these are taken.

        The search goes on where the last one gave up, so that full regions are not tried
        again and again; a single child takes the first free slot.
        """
        while self._free < len(self._used) and self._used[self._free]:
            self._free += 1
        steps, found = own - own[0], None
        at = self._free if len(own) == 1 or self._hint < self._free else self._hint
        for _ in range(tries):
            if at + steps[-1] >= self._end:
                break
            if not self._used[at + steps].any():
                found = at + steps
                break
            free = np.flatnonzero(~self._used[at + 1:at + 257])
            at += 1 + int(free[0]) if len(free) else 257
        if len(own) > 1:
            self._hint = at if at + steps[-1] < self._end else 0
        if found is None:
            at = self._free if len(own) == 1 else max(self._free, self._end - int(steps[-1]))
            while at < self._end and self._used[(at + steps)[at + steps < self._end]].any():
                at += 1
            found = at + steps
        if found[-1] >= len(self._used):
            self._used = np.concatenate((self._used, np.zeros(max(len(self._used), int(found[-1]) + 1), dtype=bool)))
        self._used[found] = True
        self._end = max(self._end, int(found[-1]) + 1)
        return int(found[0] - own[0])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states by symbols; -1 where there is none."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the distinct pairs, in order."""
    if not len(a):
        return np.empty(0, dtype=np.int64)
    order = np.lexsort((b, a))
    new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


_NODE = (
    "edge boolean, top boolean, k1 bigint, k2 bigint, pk1 bigint, pk2 bigint, depth bigint, n bigint, conv_id bigint, parent_conv_id bigint, kids bigint, "
    "leaves bigint, saved bigint, chars bigint")
_NODE_ARROW = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in _NODE.split(", ")])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of paths."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    paths = pa.Table.from_batches(batches)
    column = lambda c: paths.column(c).to_numpy()
    lists = paths.column("seq").combine_chunks()
    size, turns = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    t1, t2, chars, p1, p2 = (turns.field(c).to_numpy() for c in ("t1", "t2", "chars", "p1", "p2"))
    weight, conv, goes_on = column("n"), column("conv_id"), paths.column("goes_on").to_numpy(zero_copy_only=False)
    s1, s2, depth0 = column("s1"), column("s2"), column("depth")
    symbol = _dense(t1, t2)
    start = _dense(s1, s2) + int(symbol.max(initial=0))
    at = np.concatenate(([0], np.cumsum(size)[:-1]))

    # Level by level: the distinct (node, symbol) pairs are the next nodes. Level 0 has the prefixes that the paths hang on.
    levels, parents, symbols, node, n = int(size.max()) + 1, [], [], np.zeros(len(size), dtype=np.int64), 1
    by_length = np.argsort(size, kind="stable")
    alive = [by_length[np.searchsorted(size[by_length], k):] for k in range(levels)]
    for k in range(levels):
        paths_here = alive[k]
        own = start[paths_here] if k == 0 else symbol[at[paths_here] + k - 1]
        wide = np.int64(own.max()) + 1
        pair, back = np.unique(node[paths_here] * wide + own, return_inverse=True)
        parents.append(pair // wide)
        symbols.append(pair % wide)
        node[paths_here] = n + back
        n += len(pair)
    trie = DoubleArray(np.concatenate(parents), np.concatenate(symbols))

    m = len(trie.check)
    count, least, depth, long, kids, leaves, saved = (np.zeros(m, dtype=np.int64) for _ in range(7))
    least[:] = _NOBODY
    key1, key2 = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    edge = np.zeros(m, dtype=bool)
    shown = goes_on.copy()
    shown[[0, -1]] = True
    state, seen = np.zeros(len(size), dtype=np.int64), []
    for k in range(levels):
        paths_here = alive[k]
        place = at[paths_here] + k - 1
        before = state[paths_here]
        to = trie.step(before, start[paths_here] if k == 0 else symbol[place])
        state[paths_here] = to
        if k == 0:
            key1[to], key2[to], edge[to] = s1[paths_here], s2[paths_here], True
            counted = paths_here[depth0[paths_here] == 0]
        else:
            key1[to], key2[to], long[to] = key1[before] ^ p1[place], key2[before] ^ p2[place], chars[place]
            edge[to[shown[paths_here]]] = True
            counted = paths_here
        depth[to] = depth0[paths_here] + k
        np.add.at(count, state[counted], weight[counted])
        np.minimum.at(least, state[counted], conv[counted])
        seen.append(np.unique(to))
    for here in reversed(seen[1:]):
        own = here[~edge[here]]
        saved[own] += (count[own] - 1) * long[own]
        leaves[own] += kids[own] == 0
        up = trie.check[own]
        np.add.at(kids, up, 1)
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])

    every = np.concatenate(seen)
    up, first = trie.check[every], np.arange(len(every)) < len(seen[0])
    top = ~first & edge[up]
    known = lambda a, ok: pa.array(a, mask=~ok)
    somebody = least[every] != _NOBODY
    yield from pa.Table.from_arrays(
        [pa.array(edge[every]), pa.array(top), pa.array(key1[every]), pa.array(key2[every]), known(key1[up], ~first), known(key2[up], ~first), pa.array(depth[every]),
         pa.array(count[every]), known(least[every], somebody), known(least[up], ~first & ~edge[up]), pa.array(kids[every]), pa.array(leaves[every]),
         pa.array(saved[every]), pa.array(long[every])], schema=_NODE_ARROW).to_batches(10_000)


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, t1, t2, chars) of every rebuilt turn, d from 1, and (conv_id, total) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"), F.length(text).cast("bigint").alias("chars"))
    ranked = settle(global_rank(rows, "conv_id", "turn", "role", "t1", "t2").drop("turn", "role"), "ranked")
    own = F.col("conv_id")
    sizes = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes.withColumns({"h": F.crc32(own.cast("string").cast("binary")) % 6, "base": own - own % 100}), "sizes")
    bases = sizes.filter("conv_id = base").select("base", F.col("n").alias("held"))
    plan = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    plan = settle(plan.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    placed = ranked.join(plan.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("i", F.col("rank") - F.col("first"))
    mine = placed.filter("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("d"), "t1", "t2", "chars")
    # At most five rows of a base, to at most a hundred conversations.
    heads = placed.filter("i < 5 AND conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "i", "t1", "t2", "chars")
    heads = plan.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("i < taken")
    heads = heads.select("conv_id", (F.col("i") + 1).alias("d"), "t1", "t2", "chars")
    return settle(mine.unionByName(heads), "turns"), plan.select("conv_id", "total")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key; rows come sorted by key and id, and are not kept."""
    key, digest = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(k1) != 0) | (np.diff(k2) != 0), [True])))
        done = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            joined = ",".join(map(str, ids[a:b].tolist())).encode()
            if key == (k1[a], k2[a]):
                digest.update(b"," + joined)
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (int(k1[a]), int(k2[a])), hashlib.sha256(joined)
        yield rows(done)
    if key is not None:
        yield rows([(*key, digest.hexdigest())])


def _sums_below(edges: DataFrame) -> DataFrame:
    """k1, k2, leaves, saved summed over all of ``edges`` at or below each, by pointer doubling along (pk1, pk2)."""
    now = settle(edges.select("k1", "k2", F.col("pk1").alias("a1"), F.col("pk2").alias("a2"), "leaves", "saved"), "upper")
    while now.filter("a1 IS NOT NULL").limit(1).count():
        below = now.filter("a1 IS NOT NULL")
        more = below.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        further = now.filter("a1 IS NOT NULL").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        jumped = below.select("k1", "k2", "a1", "a2").join(further, ["a1", "a2"]).select("k1", "k2", "b1", "b2")
        now = now.join(more, ["k1", "k2"], "left").join(jumped, ["k1", "k2"], "left").select(
            "k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("extra", F.lit(0))).alias("saved"))
        now = settle(now, "upper")
    return now.select("k1", "k2", "leaves", "saved")


def trie_nodes(conversations: DataFrame, chunk: int = CHUNK, shard_turns: int = 400_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    spark = conversations.sparkSession
    turns, totals = rebuild(conversations)
    turns = turns.withColumns({"part": F.floor((F.col("d") - 1) / chunk), "p1": F.xxhash64(F.lit(1), "t1", "t2", "d"), "p2": F.xxhash64(F.lit(2), "t1", "t2", "d")})
    xors = [F.bit_xor("p1").alias("x1"), F.bit_xor("p2").alias("x2")]
    parts = settle(turns.groupBy("conv_id", "part").agg(*xors), "parts")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    longer = totals.filter(F.col("total") > chunk).select("conv_id")
    starts = parts.join(longer, "conv_id", "left_semi").withColumns({"s1": F.bit_xor("x1").over(before), "s2": F.bit_xor("x2").over(before)}).filter("part > 0")

    whole = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("d", "t1", "t2", "chars", "p1", "p2"))).alias("seq"), *xors)
    whole = whole.join(starts.select("conv_id", "part", "s1", "s2"), ["conv_id", "part"], "left").join(totals, "conv_id")
    zero = F.lit(0).cast("bigint")
    whole = whole.withColumns({"s1": F.coalesce("s1", zero), "s2": F.coalesce("s2", zero), "depth": F.col("part") * chunk})
    whole = whole.withColumn("goes_on", F.col("depth") + F.size("seq") < F.col("total"))
    paths = whole.groupBy("s1", "s2", "depth", "x1", "x2").agg(
        F.any_value("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("goes_on").alias("goes_on"))
    paths = settle(paths.withColumn("place", F.transform("seq", lambda s: F.struct(s["t1"], s["t2"]))), "paths")
    held = paths.agg(F.sum(F.size("seq"))).first()[0] or 0
    # Small shards only cost nodes that two of them share.
    shards = max(1, -(-held // shard_turns), min(partitions(spark), -(-held // 20_000)))
    ranges = paths.repartitionByRange(shards, "s1", "s2", "place").sortWithinPartitions("s1", "s2", "place").drop("place")
    found = settle(ranges.mapInArrow(_shard, _NODE), "nodes")

    turnless = totals.filter("total = 0").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n > 0")
    alone = turnless.select(*[F.col(c) if c in ("n", "conv_id") else F.lit(None if c in ("pk1", "pk2", "parent_conv_id") else c == "edge" if c in ("edge", "top") else 0).cast(t).alias(c)
                              for c, t in (x.split() for x in _NODE.split(", "))])
    upper = found.filter("edge").unionByName(alone).groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in ("pk1", "pk2", "depth", "chars")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")])
    upper = settle(upper, "merged")
    children = upper.filter("pk1 IS NOT NULL").groupBy(F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(F.count(F.lit(1)).alias("more"))
    upper = upper.join(children, ["k1", "k2"], "left").withColumn("kids", F.col("kids") + F.coalesce("more", zero)).drop("more")
    upper = upper.withColumns({"leaves": F.col("leaves") + (F.col("kids") == 0).cast("bigint"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars")})
    upper = settle(upper, "merged")
    upper = settle(upper.drop("leaves", "saved").join(_sums_below(upper), ["k1", "k2"]), "merged")

    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n", "kids", "leaves", "saved"]
    names = upper.select(F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent_conv_id"))
    below = found.filter("NOT edge AND top").drop("parent_conv_id").select("pk1", "pk2", *[c for c in columns if c != "parent_conv_id"])
    below = below.unionByName(upper.select(*below.columns)).join(names, ["pk1", "pk2"], "left").select(columns)
    nodes = found.filter("NOT edge AND NOT top").select(columns).unionByName(below)

    ends = parts.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    ends = ends.unionByName(totals.filter("total = 0").select("conv_id", zero.alias("k1"), zero.alias("k2")))
    hashed = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_ends, "k1 bigint, k2 bigint, ends_sha256 string")
    return nodes.join(hashed, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: For DuckDB, which has no crc32: it is worked out bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sums AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)),
sizes AS (SELECT conv_id, n, base, xor(crc, 4294967295) % 6 AS h FROM sums),
plan AS (
  SELECT s.conv_id, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT p.conv_id, t.i + 1 AS d, role, text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.i < p.taken
  UNION ALL
  SELECT p.conv_id, t.i - p.h + p.taken + 1, role, text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.i >= p.h),
named AS (
  SELECT conv_id, d, length(text) AS chars,
         md5(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM plan),
lengths AS (SELECT conv_id, max(d) AS total FROM named GROUP BY conv_id),
nodes AS (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM named GROUP BY k),
parents AS (
  SELECT n.k, p.k AS pk FROM nodes n JOIN named p ON p.conv_id = n.conv_id AND p.d = n.depth - 1),
children AS (SELECT pk, count(*) AS n_children FROM parents GROUP BY pk),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.pk = n.k),
below AS (
  SELECT a.k, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved_tokens
  FROM own o JOIN named a ON a.conv_id = o.conv_id AND a.d <= o.depth GROUP BY a.k),
ends AS (
  SELECT n.k, sha256(string_agg(n.conv_id::VARCHAR, ',' ORDER BY n.conv_id)) AS ends_sha256
  FROM named n JOIN lengths l ON l.conv_id = n.conv_id AND l.total = n.d GROUP BY n.k)
SELECT o.conv_id, o.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN below USING (k) LEFT JOIN parents p USING (k) LEFT JOIN nodes q ON q.k = p.pk LEFT JOIN ends USING (k)
"""
