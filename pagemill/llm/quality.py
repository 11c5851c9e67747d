"""Quality by co-training.

Two classifiers see different views of a page: its text (how character classes follow
each other, repetition of words and lines) and its metadata (source, language,
length). Both start from a bounded sample of labelled rows. In each round either
one labels the pages of an unlabelled pool that it is sure about, in the proportion of
the labels, and the other one learns from them. In the end both views are calibrated
on labelled rows held back from training, and combined by a logistic curve.

Defined results: a null text is empty; null metadata are a value of their own (n_chars
falls back to the text's length). Rows without a label are never learnt from as
labelled; without both labels every score is 1, so that nothing is rejected. Repeated
rows repeat. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_sample, fit_logistic, settle, sigmoid, slices, texts

_CLASSES = 16
_SOURCES, _LANGS, _LENGTHS = 64, 16, 24
TEXT_DIMS, META_DIMS = _CLASSES * _CLASSES + 5, _SOURCES + _LANGS + _LENGTHS


def _class_table() -> np.ndarray:
    """Byte -> class: letters by case, digits, white space, some punctuation, the rest, non-ASCII."""
    of = np.full(256, 14, dtype=np.uint8)
    of[128:] = 15
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "'\"", "-:;", "#", "$%", "&*", "|/\\")):
        of[list(chars.encode())] = k
    return of


_CLASS = _class_table()


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of class pairs, and five measures of repetition and shape."""
    body = text.encode("utf-8", "replace")
    view = np.zeros(TEXT_DIMS, dtype=np.float32)
    if len(body) > 1:
        c = _CLASS[np.frombuffer(body, dtype=np.uint8)].astype(np.int16)
        pairs = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
        view[:-5] = np.sqrt(pairs / pairs.sum())
    words, lines = body.split(), [x for x in body.split(b"\n") if x]
    n = max(1, len(words))
    # Repetition is measured over stretches of 100 words, so that it means the same at every length.
    distinct = sum(len(set(words[i:i + 100])) for i in range(0, len(words), 100))
    view[-5:] = (distinct / n, len(set(lines)) / max(1, len(lines)), min(2.0, len(body) / n / 10), 1 / np.sqrt(n), min(1.0, len(lines) / n * 5))
    return view


def meta_view(source: str | None, lang: str | None, n_chars: int) -> np.ndarray:
    view = np.zeros(META_DIMS, dtype=np.float32)
    view[zlib.crc32((source or "\0").encode()) % _SOURCES] = 1
    view[_SOURCES + zlib.crc32((lang or "\0").encode()) % _LANGS] = 1
    view[_SOURCES + _LANGS + min(_LENGTHS - 1, max(0, n_chars).bit_length())] = 1
    return view


@dataclass(frozen=True)
class QualityModel:
    """A weight vector for each view, a calibration (slope, offset) for each, and the weights of the combination."""

    text: np.ndarray | None
    meta: np.ndarray | None
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mix: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.ones(len(text))
        (a, b), (c, d) = self.calibration
        views = np.stack([a * _margin(self.text, text) + b, c * _margin(self.meta, meta) + d], axis=1)
        return sigmoid(views @ self.mix[:-1] + self.mix[-1])


def _margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30.0, 30.0)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    body = texts(batch)
    meta = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), body, strict=True)
    return (
        np.stack([text_view(t) for t in body]) if body else np.zeros((0, TEXT_DIMS), np.float32),
        np.stack([meta_view(s, g, len(t) if n is None else n) for s, g, n, t in meta]) if body else np.zeros((0, META_DIMS), np.float32),
    )


def _columns(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "cast(doc_id as bigint) as doc_id", "text", "cast(source as string) as source", "cast(lang as string) as lang", "cast(n_chars as bigint) as n_chars"
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = 6_000, pool: int = 6_000, rounds: int = 4, sure: float = 0.95) -> QualityModel:
    """Learn from the ``rows`` labelled and ``pool`` unlabelled documents whose ids hash lowest.

    The driver gets the features of these rows, about 1.5 kB each. Of an id's rows one
    teaches for each label, that with the least digest of its text, and of equal texts
    the one with the least metadata.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id IS NOT NULL")
    chosen = bounded_sample(known.filter("quality IN (0, 1)"), "_id", rows)
    others = docs.select(F.col("doc_id").cast("bigint").alias("_id")).join(known, "_id", "left_anti").filter("_id IS NOT NULL").distinct()
    others = bounded_sample(others, "_id", pool).withColumn("quality", F.lit(-1))
    sample = F.broadcast(settle(chosen.unionByName(others), "sample"))  # rows + pool ids

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            text, meta = _views(batch)
            packed = [pa.array([r.tobytes() for r in v], type=pa.binary()) for v in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *packed], names=["doc_id", "quality", "text", "meta"])

    seen = _columns(docs).join(sample, F.col("doc_id") == F.col("_id")).drop("_id")
    # Reduced inside each task first, so that an id with very many rows is no hot spot.
    row = F.struct(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "source", "lang", "n_chars", "text")
    seen = seen.groupBy("doc_id", "quality").agg(F.min(row).alias("row")).select("doc_id", "quality", "row.text", "row.source", "row.lang", "row.n_chars")
    seen = seen.mapInArrow(views, "doc_id bigint, quality int, text binary, meta binary").toArrow()
    order = np.lexsort((seen.column("quality").to_numpy(), seen.column("doc_id").to_numpy()))
    y = seen.column("quality").to_numpy()[order]
    x = [np.frombuffer(b"".join(seen.column(c).to_pylist()), dtype=np.float32).reshape(-1, d)[order] for c, d in (("text", TEXT_DIMS), ("meta", META_DIMS))]
    return cotrain(x, y, np.array([zlib.crc32(str(i).encode()) for i in seen.column("doc_id").to_numpy()[order]]), rounds, sure)


def cotrain(x: list[np.ndarray], y: np.ndarray, draw: np.ndarray, rounds: int, sure: float) -> QualityModel:
    """Exchange sure labels of the pool (``y`` = -1) between two views; calibrate on a quarter of the labelled rows."""
    held = (y >= 0) & (draw % 4 == 0)
    base = (y >= 0) & ~held
    if len(set(y[held])) < 2 or len(set(y[base])) < 2:
        return QualityModel(None, None, ((1.0, 0.0), (1.0, 0.0)), np.zeros(3))
    share = y[base].mean()
    taught = [np.where(base, y, -1), np.where(base, y, -1)]
    models: list[np.ndarray] = []
    for turn in range(rounds + 1):
        models = [fit_logistic(v[t >= 0], t[t >= 0].astype(float), l2=0.3) for v, t in zip(x, taught, strict=True)]
        if turn == rounds:
            break
        for me, peer in ((0, 1), (1, 0)):
            p = sigmoid(_margin(models[me], x[me]))
            free = np.flatnonzero((y < 0) & (taught[peer] < 0))
            most = max(1, len(free) // (2 * rounds))
            for label, chance, part in ((1, p, share), (0, 1 - p, 1 - share)):
                ranked = free[np.argsort(-chance[free], kind="stable")][: max(1, int(most * part))]
                taught[peer][ranked[chance[ranked] >= sure]] = label
    truth = y[held].astype(float)
    lines = []
    for w, v in zip(models, x, strict=True):
        line = fit_logistic(_margin(w, v[held])[:, None], truth, l2=0.01)
        lines.append((float(line[0]), float(line[1])))
    views = np.stack([a * _margin(w, v[held]) + b for (a, b), w, v in zip(lines, models, x, strict=True)], axis=1)
    return QualityModel(models[0], models[1], (lines[0], lines[1]), fit_logistic(views, truth, l2=0.01))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (chance of good quality) and keep (score at or above ``threshold``), one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 500):
            p = own.score(*_views(batch)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id bigint, score double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows at or above the threshold, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 500):
            yield batch.filter(pa.array(own.score(*_views(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
