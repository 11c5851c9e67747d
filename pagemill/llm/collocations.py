"""Collocations of two and three words per language, by best-first growth with admissible bounds.

Counts of words bound those of pairs, counts of pairs those of triples: a phrase is
never more frequent than its parts, so only frequent words are paired, and a triple
``w1 w2 w3`` scores at most ``f(w1 w2) / f(w1)`` by its first cut, whatever ``w3`` is. The
frontier of prefixes ``w1 w2`` is expanded in order of that bound, a batch of prefixes per
scan of the texts:

1. A score is set per language that a multiple of the wanted number of pairs reaches.
2. Every prefix whose bound reaches it is expanded, and every prefix that may hold a
   triple frequent enough to drop a pair which reaches it. Then all candidates that
   reach the score are known, and so is which of them are dropped.
3. A language with as many survivors as wanted is settled: nothing unexpanded can reach
   its score, ties included. The others go on with a lower score, at last 0.

Words are cut and counted in blocks of one language inside the tasks; equal phrases of a
block leave it once. Bloom filters of bounded size tell the tasks which words, pairs and
prefixes matter; a false positive only costs a row that is dropped, or a triple that is
counted in vain, since all counts are by the phrase itself.

Defined results: a null text is empty, a null language is ``und``. Words keep all
characters other than separators. Repeated rows count each time. Languages without
candidates, and an empty table, give no rows. Arithmetic is in 38 decimal digits, exact
for counts below 10**15; beyond, Spark raises an error. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import settle, slices

_LOW = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TURN, _MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
#: A filter has 16 bits per member, up to 16 MB; a block so many bytes of text of one language, or the last text beyond.
_MOST_BITS, _BLOCK = 27, 8 << 20


def _blend(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _TURN
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], dtype=np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _blend(first * _MIX + second)


@dataclass(frozen=True)
class Bloom:
    bits: int
    words: np.ndarray

    def positions(self, h: np.ndarray) -> np.ndarray:
        return _probes(h, self.bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for at in self.positions(h).T:
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return found


def _probes(h: np.ndarray, bits: int, probes: int = 4) -> np.ndarray:
    step = _blend(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bloom(phrases: DataFrame) -> Bloom:
    """A filter of the phrases (lang, phrase) of one or of two words; the driver gets at most 2**27 bits."""
    bits = min(_MOST_BITS, max(16, (16 * phrases.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                parts = _word_hashes(phrase.encode().split(b" "), lang)
                hashes.append(parts[0] if len(parts) == 1 else _pair_hashes(parts[:1], parts[1:2])[0])
            at = np.unique(_probes(np.array(hashes, dtype=np.uint64), bits).ravel())
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(mask)], names=["place", "mask"])

    placed = phrases.select("lang", "phrase").mapInArrow(place, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[placed.column("place").to_numpy()] = placed.column("mask").to_numpy().view(np.uint64)
    return Bloom(bits, words)


@dataclass(frozen=True)
class Block:
    """Texts of one language: a code per word, and whether the next word follows in the same piece."""

    lang: str
    codes: np.ndarray
    follows: np.ndarray
    words: pa.Array

    def hashes(self) -> np.ndarray:
        return _word_hashes(self.words.cast(pa.binary()).to_pylist(), self.lang)


def cut_words(lang: str, bodies: list[bytes]) -> Block:
    body = np.frombuffer(b"\n".join([*bodies, b""]).translate(_LOW), dtype=np.uint8)
    line_end = body == 10
    inside = ~line_end & (body != 32)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body[inside])])
    coded = words.dictionary_encode()
    piece = np.cumsum(line_end, dtype=np.int64)[start]
    return Block(lang, coded.indices.to_numpy().astype(np.int64), piece[1:] == piece[:-1], coded.dictionary)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches, 500):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                body = text.encode()
                held.setdefault(lang, []).append(body)
                size += len(body)
                if size >= _BLOCK:
                    yield from (cut_words(k, v) for k, v in held.items())
                    held, size = {}, 0
    yield from (cut_words(k, v) for k, v in held.items())


_COUNT = "lang string, phrase string, n bigint"


def _rows(lang: str, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    phrase = phrase.cast(pa.string())
    whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, type=pa.string()), len(n)), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])
    for start in range(0, len(n), 50_000):
        yield whole.slice(start, 50_000)


def _joined(block: Block, *codes: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(block.words.take(pa.array(c)) for c in codes), pa.scalar(" ", type=pa.large_string()))


def _count(docs: DataFrame, of_block: Callable[[Block], Iterator[pa.RecordBatch]], least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from of_block(block)
            pa.default_memory_pool().release_unused()

    counted = docs.mapInArrow(run, _COUNT).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return settle(counted.filter(F.col("n") >= least), "phrases")


def _one(block: Block) -> Iterator[pa.RecordBatch]:
    yield from _rows(block.lang, block.words, np.bincount(block.codes, minlength=len(block.words)))


def count_pairs(docs: DataFrame, frequent: Bloom, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most 16 MB

    def pairs(block: Block) -> Iterator[pa.RecordBatch]:
        known = shared.value.holds(block.hashes())[block.codes]
        a, b = block.codes[:-1], block.codes[1:]
        here = block.follows & known[:-1] & known[1:]
        v = max(1, len(block.words))
        key, n = np.unique(a[here] * v + b[here], return_counts=True)
        yield from _rows(block.lang, _joined(block, key // v, key % v), n)

    return _count(docs, pairs, least)


def count_triples(docs: DataFrame, prefixes: Bloom, frequent: Bloom, least: int) -> DataFrame:
    """Triples whose first two words are in ``prefixes`` and whose last two are in ``frequent``."""
    shared = docs.sparkSession.sparkContext.broadcast((prefixes, frequent))  # at most 32 MB

    def triples(block: Block) -> Iterator[pa.RecordBatch]:
        wanted, usual = shared.value
        v = max(1, len(block.words))
        h = block.hashes()
        at = np.flatnonzero(block.follows)
        pair, which = np.unique(block.codes[at] * v + block.codes[at + 1], return_inverse=True)
        named = _pair_hashes(h[pair // v], h[pair % v])
        number = np.full(len(block.codes) + 1, -1, dtype=np.int64)  # of the pair that starts at a word
        number[at] = which
        starts, ends = np.append(wanted.holds(named), False), np.append(usual.holds(named), False)  # -1: none
        here = np.flatnonzero(starts[number[:-2]] & ends[number[1:-1]]) if len(block.codes) > 2 else np.empty(0, dtype=np.int64)
        key, n = np.unique(number[here] * v + block.codes[here + 2], return_counts=True)
        first = pair[key // v] if len(key) else key
        yield from _rows(block.lang, _joined(block, first // v, first % v, key % v), n)

    return _count(docs, triples, least)


def _ratio(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)), exactly."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)}) as bigint)")


def _thresholds(scored: DataFrame, wanted: int) -> DataFrame:
    """lang, tau: a score that at least ``wanted`` rows reach, close to the highest such; 0 where there are fewer.

    By counts of at most 1,277 classes of scores, so no task orders the rows of a language.
    """
    classes = scored.groupBy("lang", F.floor(64 * F.log2(F.col("score") + 1)).alias("class")).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low"))
    reached = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("class")))
    return classes.withColumn("reached", reached).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= wanted, F.col("low"))), F.lit(0)).alias("tau"))


def _reaching(scored: DataFrame, tau: DataFrame) -> DataFrame:
    """The rows that reach their language's score. ``tau`` has a row per language, so Spark may broadcast it."""
    return scored.join(tau, "lang").filter("score >= tau").drop("tau")


def _first(words: str, k: int) -> Column:
    return F.substring_index(words, " ", k)


def collocations(docs: DataFrame, limit: int = 2000, least: int = 10, percent: int = 50, ahead: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = _count(rows, _one, 1)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    usual = settle(words.filter(F.col("n") >= least), "words")

    pairs = count_pairs(rows, bloom(usual), least)
    single = lambda c, n: usual.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    pairs = pairs.withColumns({"w1": _first("phrase", 1), "w2": _first("phrase", -1)})
    pairs = pairs.join(single("w1", "f1"), ["lang", "w1"]).join(single("w2", "f2"), ["lang", "w2"])
    pairs = settle(pairs.withColumns({"score": _ratio("n", "f1", "f2"), "bound": F.expr("cast(cast(1000000 as decimal(7, 0)) * n div f1 as bigint)")}), "pairs")
    known_pairs = bloom(pairs)

    open_, wanted = pairs.select("lang").distinct(), ahead * limit
    expanded, triples, settled = None, None, None
    while open_.limit(1).count():
        open_ = settle(open_, "open")
        mine = pairs.join(open_, "lang", "left_semi")
        tau = settle(_thresholds(mine, wanted), "tau")
        good = _reaching(mine, tau)
        # A triple x w1 w2 drops the pair w1 w2 from ``percent`` of its count on; its prefix x w1 is at least as frequent.
        need = good.groupBy("lang", F.col("w1").alias("w2")).agg(F.min("n").alias("need"))
        prefixes = mine.join(tau, "lang").join(need, ["lang", "w2"], "left").filter(f"bound >= tau OR score >= tau OR 100 * n >= {percent} * need")
        prefixes = prefixes.select("lang", "phrase")
        fresh = settle(prefixes if expanded is None else prefixes.join(expanded, ["lang", "phrase"], "left_anti"), "frontier")
        expanded = fresh if expanded is None else expanded.unionByName(fresh)
        names = [r["lang"] for r in open_.limit(1001).collect()]
        scanned = rows.filter(F.col("lang").isin(names)) if len(names) <= 1000 else rows
        grown = count_triples(scanned, bloom(fresh), known_pairs, least)
        # A false positive of an earlier filter may have counted a triple before; its count is the same.
        triples = grown if triples is None else triples.unionByName(grown).groupBy("lang", "phrase").agg(F.max("n").alias("n"))
        triples = settle(triples, "triples")

        start = pairs.select("lang", F.col("phrase").alias("start"), F.col("n").alias("n12"), "f1")
        end = pairs.select("lang", F.col("phrase").alias("end"), F.col("n").alias("n23"), F.col("f2").alias("f3"))
        longer = triples.withColumns({"start": _first("phrase", 2), "end": _first("phrase", -2)})
        drops = longer.select("lang", F.explode(F.array("start", "end")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        scored = longer.join(start, ["lang", "start"]).join(end, ["lang", "end"])
        scored = scored.withColumns({"one": _ratio("n", "f1", "n23"), "two": _ratio("n", "n12", "f3")})
        early = F.col("one") <= F.col("two")
        cut = scored.select("lang", "phrase", F.col("n").alias("a"), F.when(early, F.col("f1")).otherwise(F.col("n12")).alias("l"),
                            F.when(early, F.col("n23")).otherwise(F.col("f3")).alias("r"), F.least("one", "two").alias("score"))
        kept = good.join(drops, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {percent} * n")
        kept = kept.select("lang", "phrase", F.col("n").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
        kept = settle(kept.unionByName(_reaching(cut, tau)), "survivors")
        many = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
        state = settle(tau.join(many, "lang", "left").withColumn("over", (F.col("tau") == 0) | (F.coalesce("many", F.lit(0)) >= limit)), "state")
        done = kept.join(state.filter("over").select("lang"), "lang", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        open_, wanted = state.filter("NOT over").select("lang"), 8 * wanted
    if settled is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")

    best = _reaching(settled, _thresholds(settled, limit))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First by shares of a language, then the languages: at most 64 times ``limit`` rows meet.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= limit)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


_ALPHABET = "".join(map(chr, range(97, 123)))
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_ALPHABET.upper()}', '{_ALPHABET}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
occurrences AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lists
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists WHERE len(w) > 1
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM occurrences GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM f WHERE size = 1 GROUP BY lang),
usual AS MATERIALIZED (SELECT * FROM f WHERE n >= 10),
split AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM usual WHERE size > 1),
parts AS MATERIALIZED (SELECT *, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM split),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.n AS a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.n * c.n) // (x.n * y.n) AS score
  FROM parts c JOIN usual x ON x.lang = c.lang AND x.phrase = c.one JOIN usual y ON y.lang = c.lang AND y.phrase = c.two),
candidates AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a
  FROM (SELECT lang, string_split(phrase, ' ') AS w, a FROM candidates WHERE size = 3)),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_pairs GROUP BY ALL),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM candidates c LEFT JOIN longest d ON d.lang = c.lang AND d.phrase = c.phrase
  WHERE d.longer IS NULL OR 100 * d.longer < 50 * c.a)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
