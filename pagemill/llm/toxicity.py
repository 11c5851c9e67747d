"""Toxicity by maximum-scoring segments.

A bounded sample of labelled documents, copies once, gives, for each piece of a word (the word
itself and its substrings of 4 to 6 letters, word ends included), the log-odds
between toxic and clean documents under Dirichlet priors, and their variance. Pieces
count whose likelihood ratio stands out among so many pieces. A word weighs the lower
bound of its best piece, less a drift that makes the expected score of clean text
negative. A linear scan then finds every maximal
scoring segment of a document. By extreme-value statistics a segment of score s in n
words counts ``lambda s - log(K n)``; segments above zero are significant, and the
sum over them is turned into a probability by a logistic curve fitted to the sample.

Defined results: a null text is empty; a text without words has no segment and gets
the probability of that. Rows without a label (or whose document is missing) teach
nothing; without both labels every score is 0. Repeated rows repeat. An empty table
gives no rows. Labels, language, source and id are never read for a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_sample, fit_logistic, settle, sigmoid, slices, texts

_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 400_000


def pieces(word: str) -> set[str]:
    """The word and its substrings of 4 to 6 letters, ends marked."""
    marked = f"^{word}$"
    return {marked} | {marked[i:i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}


class Weights(dict):
    """word -> weight above the drift, else 0; remembers words up to a bound."""

    def __init__(self, known: dict[str, float], drift: float) -> None:
        super().__init__()
        self.known, self.drift = known, drift

    def __missing__(self, word: str) -> float:
        weight = max(0.0, max((self.known.get(p, 0.0) for p in pieces(word)), default=0.0) - self.drift)
        if len(self) >= _CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = weight
        return weight


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a sequence.

    ``hits`` has the words of positive score in order; every other word scores ``-drift``.
    Each candidate keeps the cumulative score before it and at its end. A new one is
    joined to the last candidate that starts lower, if that one also ends lower.
    """
    # first, last, total before, total at the end, place of the last candidate that starts lower (-1: none).
    found: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, -1
    for position, score in hits:
        total -= drift * (position - at - 1)
        first, last, low, high = position, position, total, total + score
        total, at = high, position
        k = len(found) - 1
        while True:
            # What is passed here starts no lower than this one, so nobody after will look at it again.
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= high:
                break
            first, low, before = found[k][0], found[k][2], found[k][4]
            del found[k:]
            k = before
        found.append((first, last, low, high, k))
    return [(first, last, high - low) for first, last, low, high, _ in found]


@dataclass(frozen=True)
class ToxicModel:
    known: dict[str, float]
    drift: float
    decay: float
    scale: float
    curve: tuple[float, float]

    def evidence(self, text: str, weights: Weights) -> tuple[float, list[tuple[int, int, float]]]:
        """The sum over significant segments, and these segments."""
        words = _WORD.findall(text.lower())
        hits = [(i, x) for i, w in enumerate(words) if (x := weights[w]) > 0]
        if not hits:
            return 0.0, []
        base = math.log(max(1.0, self.scale * len(words)))
        kept = [(a, b, self.decay * s - base) for a, b, s in segments(hits, self.drift)]
        kept = [x for x in kept if x[2] > 0]
        return sum(x[2] for x in kept), kept

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve[1] == -math.inf:  # nothing was learnt
            return np.zeros(len(evidence))
        return sigmoid(self.curve[0] * np.log1p(evidence) + self.curve[1])


def _decay(chances: np.ndarray, scores: np.ndarray, drift: float) -> float:
    """The positive root of sum(chance * exp(root * score)) = 1 over the words of clean text."""
    rest = max(0.0, 1.0 - chances.sum())
    low, high = 1e-6, 50.0
    for _ in range(100):
        middle = (low + high) / 2
        value = (chances * np.exp(np.minimum(middle * scores, 700.0))).sum() + rest * math.exp(-middle * drift)
        low, high = (middle, high) if value < 1 else (low, middle)
    return low


def train(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, sure: float = 1.0, prior: float = 0.5, drift: float = 1.0,
    scale: float = 0.3,
) -> ToxicModel:
    """Learn from the ``rows`` labelled documents whose ids hash lowest.

    The driver gets one number per sampled document and every piece that stands out
    between the labels: as many as the sample bears, whatever the table's size.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND _id IS NOT NULL")
    chosen = F.broadcast(bounded_sample(chosen, "_id", rows))
    sample = settle(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", "toxic").distinct(), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicModel({}, drift, 1.0, scale, (0.0, -math.inf))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        words_seen = 0

        def write() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            columns = [pa.array(keys, type=pa.string()), *(pa.array([h[k] for k in keys], type=pa.int64()) for h in (held[1], held[0]))]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays(columns, names=["piece", "toxic", "clean"])

        for batch in slices(batches, 200):
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                held[toxic].update(set().union(*map(pieces, set(words))))
                if not toxic:
                    words_seen += len(words)
            if len(held[0]) + len(held[1]) > 600_000:
                yield write()
        yield write()
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], type=pa.int64()), pa.array([words_seen], type=pa.int64())], names=["piece", "toxic", "clean"])

    counted = sample.mapInArrow(count, "piece string, toxic bigint, clean bigint")
    counted = settle(counted.groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "pieces")
    n_words = counted.filter("piece = ''").first()["clean"]
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(sizes[0] + sizes[1]))
    a = F.greatest(F.lit(prior), F.lit(10 * prior) * share)
    odds = [F.log((F.col(c) + a) / (F.lit(float(sizes[k])) - F.col(c) + F.lit(10 * prior))) for c, k in (("toxic", 1), ("clean", 0))]
    spread = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    # Twice the log of the likelihood ratio against one rate for both labels; by chance, one of m pieces reaches 2 log(m).
    both, rate = F.col("toxic") + F.col("clean"), sizes[1] / (sizes[0] + sizes[1])
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(q)))).otherwise(0.0)
    least = 2 * math.log(max(1, counted.count())) + 5
    weighed = counted.filter("piece <> ''").filter(2 * (part("toxic", rate) + part("clean", 1 - rate)) >= least)
    best = weighed.withColumn("weight", odds[0] - odds[1] - F.lit(sure) * spread).filter(F.col("weight") > drift).orderBy("piece").collect()
    known = {r["piece"]: r["weight"] for r in best}
    scores = np.array([r["weight"] - drift for r in best])
    chances = np.array([(r["clean"] + prior) / max(1, n_words) for r in best])
    # One word shares its chance among its pieces; the best of them scores.
    decay = _decay(chances / max(1.0, chances.sum() * 20), scores, drift) if len(best) else 1.0
    model = ToxicModel(known, drift, decay, scale, (0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(known, drift)
        for batch in slices(batches, 500):
            found = pa.array([model.evidence(t, weights)[0] for t in texts(batch)], type=pa.float64())
            yield pa.RecordBatch.from_arrays([found, batch.column("toxic")], names=["evidence", "toxic"])

    seen = sample.mapInArrow(measure, "evidence double, toxic int").toArrow()
    w = fit_logistic(np.log1p(seen.column("evidence").to_numpy())[:, None], seen.column("toxic").to_numpy().astype(float), l2=0.1)
    return ToxicModel(known, drift, decay, scale, (max(0.0, float(w[0])), float(w[1])))


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, passages (first and last word of each significant segment)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the pieces that stood out in the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = Weights(own.known, own.drift)
        for batch in slices(batches, 500):
            found = [own.evidence(t, weights) for t in texts(batch)]
            p = own.score(np.array([f[0] for f in found]))
            spans = [",".join(f"{a}:{b}" for a, b, _ in f[1]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(spans, type=pa.string())],
                names=["doc_id", "score", "predicted", "passages"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int, passages string")
