"""Documents linked by the Jaccard similarity of their word shingles: a grouped prefix join.

1. Each task turns texts into sorted sets of shingle hashes and exchanges them, as packed
   blocks over ranges of the hash space, for the number of documents that hold each
   shingle. Blocks get back only what two or more documents hold. A set of n can have a
   partner only if at least the threshold's share of it came back; all others are done.
2. The shingles of a candidate are ordered by that number and by hash. A partner must
   share one of the first n - ceil(threshold * n) + 1, the prefix. Equal sets are one
   node; nodes of equal prefix and size are one group.
3. Groups that share a prefix shingle are compared with one group of the same size class
   there, that with the fewest shingles of its own (copies have such where they were
   changed, the text they come from has none), and members with the first of their
   group; exact overlaps give links.
4. Only where a shingle still joins different components, all remaining pairs of
   members in different ones, filtered by size and by their positions in the prefix, are
   verified as well. So no link between components is lost, and a large group costs its
   size times the number of its members that the first round left apart.

The result is components, not pairs: links that join no components are not all verified,
and none is listed or counted.

Defined results: words are runs of anything but ASCII white space, with A-Z lowered; a
text of fewer words than a shingle is one shingle; a text without words, or null, has
none and is alone. Rows that share a doc_id are one node of the graph, whatever their
texts: they give one row for each different shingle set, all with the id's component. A null
doc_id is alone and gives null. An empty table gives no rows. Only doc_id and text are
read. Shingles are compared by 64-bit hashes in sets and by their upper 48 bits between
sets, where a false match in a pair of a thousand shingles each has a chance below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import partitions, settle, slices
from pagemill.llm.components import components

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_MANY = 0xFFFF
#: A block holds up to so many shingles (or the last document over that) and documents.
_BLOCK_SHINGLES, _BLOCK_DOCS = 250_000, 60_000


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    powers = np.full(1 << bits, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _blend(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    body = np.frombuffer(b" ".join([*texts, b""]).lower(), dtype=np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[body]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bits = max(16, int(len(body) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[body] * _powers(_STEP, bits)[: len(body)], dtype=np.uint64)))
    back = _powers(pow(_STEP, -1, 1 << 64), bits)
    word = _blend((sums[end] - sums[start]) * back[start])
    limits = np.concatenate(([0], np.searchsorted(start, ends_at)))
    many = np.uint64(0xA24BAED4963EE407)
    rolled = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * many + word[k:k + len(rolled)]
    rolled = _blend(rolled)
    found = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if b - a >= words:
            found.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            h = b - a
            for w in word[a:b].tolist():
                h = (h * int(many) + w) & ((1 << 64) - 1)
            found.append(_blend(np.array([h], dtype=np.uint64)))
        else:
            found.append(np.empty(0, dtype=np.uint64))
    return found


def _squeeze(tokens: np.ndarray) -> bytes:
    """Sorted numbers below 2**48 as steps, four bytes each where that is enough."""
    steps = np.diff(tokens, prepend=np.uint64(0))
    if len(steps) and int(steps[1:].max(initial=0)) < 1 << 32:
        return b"\x04" + steps[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"\x08" + steps.tobytes()


def _spread(packed: bytes) -> np.ndarray:
    if packed[:1] == b"\x04":
        steps = np.concatenate((np.frombuffer(packed[1:9], dtype=np.uint64), np.frombuffer(packed[9:], dtype=np.uint32).astype(np.uint64)))
    else:
        steps = np.frombuffer(packed[1:], dtype=np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


# kind 0: shingles of a block within a range; 1: a block's documents; 2: who holds the shingles that several documents of the block hold.
_ROW = "part int, block bigint, kind int, tokens binary, docs binary, counts binary"
_ROW_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ROW_ARROW)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ROW_ARROW, strict=True)], schema=_ROW_ARROW)


def _block(block: int, parts: int, ids: list, sets: list[np.ndarray]) -> list[tuple]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    known = np.array([i is not None for i in ids])
    rows = [(block % parts, block, 1, np.array([i or 0 for i in ids], dtype=np.int64).tobytes(), sizes.tobytes() + known.tobytes(), digests)]
    tokens = np.concatenate(sets) >> np.uint64(16)
    docs = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
    count = np.diff(first, append=len(tokens))
    several = np.repeat(count > 1, count)
    if several.any():
        rows.append((block % parts, block, 2, _squeeze(tokens[several]), docs[several].tobytes(), b""))
    holder = np.where(count > 1, np.uint16(_MANY), docs[first])
    unique = tokens[first]
    cuts = np.searchsorted(((unique >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
    for part in range(parts):
        a, b = cuts[part], cuts[part + 1]
        if b > a:
            more = count[a:b][count[a:b] > 1].astype(np.uint32)
            rows.append((part, block, 0, _squeeze(unique[a:b]), holder[a:b].tobytes(), more.tobytes()))
    return rows


def _to_blocks(parts: int, words: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sets: list[np.ndarray] = []
        held, block = 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches, 200):
            bodies = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), shingle_sets(bodies, words), strict=True):
                ids.append(doc_id)
                sets.append(one)
                held += len(one)
                if held >= _BLOCK_SHINGLES or len(ids) >= most:
                    yield from _rows(_block(block, parts, ids, sets)).to_batches()
                    ids, sets, held, block = [], [], 0, block + 1
        if ids:
            yield from _rows(_block(block, parts, ids, sets)).to_batches()

    return run


def _count_range(group: pa.Table) -> pa.Table:
    """For one range of the hash space: what two or more documents hold, back to each block with the count."""
    out, blocks, tokens, docs, counts = [], [], [], [], []
    for row in group.to_pylist():
        if row["kind"]:
            out.append(tuple(row[c] for c in _ROW_ARROW.names))
            continue
        mine = _spread(row["tokens"])
        holder = np.frombuffer(row["docs"], dtype=np.uint16)
        count = np.ones(len(mine), dtype=np.uint32)
        count[holder == _MANY] = np.frombuffer(row["counts"], dtype=np.uint32)
        blocks.append(row["block"])
        tokens.append(mine)
        docs.append(holder)
        counts.append(count)
    if tokens:
        owner = np.repeat(np.arange(len(blocks)), [len(t) for t in tokens])
        every, holder, count = np.concatenate(tokens), np.concatenate(docs), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, holder, count, owner = every[order], holder[order], count[order], owner[order]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)))
        held = np.add.reduceat(count.astype(np.uint64), first)
        held = np.repeat(held, np.diff(first, append=len(every)))
        shared = np.flatnonzero(held > 1)
        shared = shared[np.argsort(owner[shared], kind="stable")]
        cuts = np.searchsorted(owner[shared], np.arange(len(blocks) + 1))
        for k, block in enumerate(blocks):
            at = shared[cuts[k]:cuts[k + 1]]
            if len(at):
                out.append((0, block, 0, _squeeze(every[at]), holder[at].tobytes(), np.minimum(held[at], (1 << 32) - 1).astype(np.uint32).tobytes()))
    pa.default_memory_pool().release_unused()
    return _rows(out)


_SETS = "doc_id bigint, n bigint, digest binary, tokens binary, singles bigint, prefix array<bigint>, prefix_key binary"
_SETS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("singles", pa.int64()), ("prefix", pa.list_(pa.int64())),
    ("prefix_key", pa.binary())])


def _finish(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """For one block: each document, and for candidates the shared shingles and the prefix."""
        tokens, docs, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        local = None
        for row in group.to_pylist():
            if row["kind"] == 1:
                head = row
            elif row["kind"] == 2:
                local = _spread(row["tokens"]), np.frombuffer(row["docs"], dtype=np.uint16)
            else:
                tokens.append(_spread(row["tokens"]))
                docs.append(np.frombuffer(row["docs"], dtype=np.uint16).astype(np.int64))
                counts.append(np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64))
        ids = np.frombuffer(head["tokens"], dtype=np.int64)
        sizes = np.frombuffer(head["docs"][: 8 * len(ids)], dtype=np.int64)
        known = np.frombuffer(head["docs"][8 * len(ids):], dtype=bool)
        token, doc, count = np.concatenate(tokens), np.concatenate(docs), np.concatenate(counts)
        if local is not None:  # several documents of this block hold it
            many = np.flatnonzero(doc == _MANY)
            many = many[np.argsort(token[many])]
            at = np.searchsorted(token[many], local[0])
            alone = doc != _MANY
            count = np.concatenate((count[alone], count[many[at]]))
            token, doc = np.concatenate((token[alone], local[0])), np.concatenate((doc[alone], local[1].astype(np.int64)))
        came = np.bincount(doc, minlength=len(ids))
        need = -(-percent * sizes // 100)
        candidate = (came >= need) & (sizes > 0) & known
        mine = candidate[doc]
        token, doc, count = token[mine], doc[mine], count[mine]
        order = np.lexsort((token, count, doc))
        token, doc = token[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = []
        for k in range(len(ids)):
            base = (int(ids[k]) if known[k] else None, int(sizes[k]), head["counts"][16 * k:16 * k + 16])
            if not candidate[k]:
                out.append((*base, None, None, None, None))
                continue
            own = token[cuts[k]:cuts[k + 1]]
            singles = int(sizes[k] - came[k])
            prefix = own[: int(sizes[k] - need[k]) + 1 - singles].astype(np.int64)
            key = base[2] if singles else xxhash.xxh3_128_digest(prefix.tobytes())
            out.append((*base, np.sort(own).tobytes(), singles, prefix, key))
        pa.default_memory_pool().release_unused()
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SETS_ARROW, strict=True)], schema=_SETS_ARROW)

    return run


def shingled(docs: DataFrame, words: int, percent: int, block_docs: int = _BLOCK_DOCS) -> DataFrame:
    """doc_id, n, digest of the set; for candidates the shared shingles, their prefix and its key. One row per row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # About half a million shingles a range.
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), letters // 3_000_000 + 1)
    blocks = rows.mapInArrow(_to_blocks(parts, words, block_docs), _ROW)
    counted = blocks.groupBy("part").applyInArrow(_count_range, _ROW)
    return settle(counted.groupBy("block").applyInArrow(_finish(percent), _SETS), "shingled")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by exact overlap."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            keep = []
            for na, nb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True):
                a, b = np.frombuffer(ta, dtype=np.uint64), np.frombuffer(tb, dtype=np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(100 * both >= percent * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, block_docs: int = _BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and set_id (the least doc_id of an equal set)."""
    rows = shingled(docs, words, percent, block_docs)
    same = settle(rows.filter("tokens IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "same")
    found = rows.filter("tokens IS NOT NULL").join(same.select("rep", F.col("digest").alias("_d"), F.col("n").alias("_n")), F.col("doc_id") == F.col("rep"))
    found = found.filter("digest = _d AND n = _n").dropDuplicates(["rep", "digest"]).drop("_d", "_n", "doc_id")
    groups = settle(found.groupBy("n", "prefix_key").agg(F.min("rep").alias("gid")), "groups")
    sets = settle(found.join(groups, ["n", "prefix_key"]), "sets")
    places = sets.select("rep", "gid", "n", F.posexplode("prefix").alias("at", "token"), "singles")
    places = settle(places.withColumn("left", F.col("n") - F.col("singles") - F.col("at")).drop("at"), "prefixes")

    # ``left``: how many shingles, this one included, may still be shared.
    fits = f"{100 + percent} * least(x.left, y.left) >= {percent} * (x.n + y.n)"
    sized = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    heads = places.filter("rep = gid").withColumn("level", level)
    lead = heads.groupBy("token", "level").agg(F.min(F.struct("singles", "n", "rep", "left")).alias("s"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # Written, so that both sides of the join are plain exchanges, whose hot partitions Spark splits.
    lead = settle(lead.select("token", "level", "s.*"), "lead")
    first = heads.alias("x").join(lead.alias("y"), ["token", "level"]).filter(f"x.rep <> y.rep AND {sized} AND {fits}")
    first = first.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    first = first.unionByName(sets.filter("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))).distinct()
    first = settle(first, "pairs")
    # Different sets of one id are linked by it. Nodes are ids, and a set stands for the least id that holds it.
    named = rows.filter("doc_id IS NOT NULL").select("doc_id", "digest", "n").distinct()
    repeated = settle(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("doc_id"), "repeated")
    held = named.join(repeated, "doc_id").join(same, ["digest", "n"]).filter("doc_id <> rep")
    held = held.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))
    links = settle(verify(first, sets, percent).unionByName(held), "links")
    parts = settle(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    # Where different components still meet.
    named = places.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    met = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    met = met.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = settle(met, "met")
    named = settle(named.join(met.select("token", "main"), "token").select("token", "rep", "n", "left", "component", "main"), "open")
    # One side of a pair is outside the component with most members there.
    outside = named.filter("component <> main")
    rest = outside.alias("x").join(named.alias("y"), "token").filter(f"x.component <> y.component AND {sized} AND {fits}")
    rest = rest.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = settle(verify(settle(rest, "rest"), sets, percent), "links")
    parts = settle(components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    reach = settle(same.join(parts, same["rep"] == parts["node"], "left").select("digest", "n", "rep", F.coalesce("component", "rep").alias("component")), "reach")
    out = rows.select("doc_id", "n", "digest").distinct().join(reach, ["digest", "n"], "left")
    # A candidate's set may also be held by a row that is no node, such as one without id.
    found = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    if repeated.limit(1).count():  # a set of the id that nobody else has, or an empty one, follows the id
        of_id = repeated.join(parts, repeated["doc_id"] == parts["node"]).select("doc_id", F.col("component").alias("of_id"))
        out = out.join(of_id, "doc_id", "left")
        found = F.coalesce("of_id", found)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("set_id"),
    )


def drop_linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, with their columns.

    An id stays once, with the row of its text that has the least digest; without an id,
    each different text does. The one exchange of the texts serves the join and repeated rows.
    """
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    found = link_components(docs, words, percent).filter("doc_id IS NULL OR component_id = doc_id").select(name.alias("_name")).distinct()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    marks = {"_name": name, "_text": F.when(F.col("doc_id").isNull(), digest), "_digest": digest}
    first = Window.partitionBy("_name", "_text").orderBy("_digest")
    kept = docs.withColumns(marks).join(found, "_name").withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    return kept.select(*docs.columns)
