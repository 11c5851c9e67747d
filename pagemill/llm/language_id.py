"""Language identification by bit-sliced Bloom filters of n-grams.

Training gathers, for each language, every n-gram of letters of its documents. Each
n-gram sets a few positions; a position holds a bitmask with one bit per language, so
that ANDing the masks at an n-gram's positions gives all languages that contain it, at
one look-up for all of them. A text is decided by the number of its n-grams in each
language, corrected for the false positives that the filter's fill makes expect.

The number of positions follows the n-grams of the language with most: four for each
bit it sets, so that at most 0.24 % of foreign n-grams pass. It ends where the masks of all
languages fill ``held`` bytes; beyond, more pass and the correction takes them off again,
but no n-gram is left out. ``LanguageFilter.rates`` says what passes.

Defined results: a text that is null or without a letter gives ``und`` and 0. A text
whose n-grams nobody knows gets the language with most training documents. Ties go
to the first label in order. Without training rows all is ``und``. Rows without text
or label teach nothing. Repeated rows count each time. A null doc_id is passed on. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import settle, slices, texts

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xFF51AFD7ED558CCD)
_LETTER: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    known = _LETTER[0][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        known[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return known


def _blend(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _TURN
    return h ^ (h >> np.uint64(29))


def grams(text: str, sizes: tuple[int, ...]) -> np.ndarray | None:
    """Distinct hashes of the n-grams of the lower-cased words, blanks around each; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    padded = np.concatenate(([32], codes, [32])).astype(np.uint64)
    padded = padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]
    found = []
    for n in sizes:
        if len(padded) >= n:
            h = np.full(len(padded) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h + padded[k:len(padded) - n + 1 + k]) * _MIX
            found.append(h)
    return np.unique(_blend(np.concatenate(found))) if found else np.empty(0, dtype=np.uint64)


def _positions(h: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """(n-grams, probes) positions, by double hashing."""
    step = _blend(h) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    """``masks[slice, position]``: 64 languages a slice."""

    languages: tuple[str, ...]
    fallback: str
    masks: np.ndarray
    rates: np.ndarray
    bits: int
    probes: int
    sizes: tuple[int, ...]

    def decide(self, text: str) -> tuple[str, float]:
        found = grams(text, self.sizes)
        if found is None or not self.languages:
            return "und", 0.0
        if not len(found):
            return self.fallback, 0.0
        at = _positions(found, self.bits, self.probes)
        hits = np.empty(len(self.languages))
        for s, mask in enumerate(self.masks):
            held = np.bitwise_and.reduce(mask[at], axis=1)
            held = held[held != 0]
            for k in range(64 * s, min(64 * s + 64, len(self.languages))):
                hits[k] = np.count_nonzero(held & (np.uint64(1) << np.uint64(k - 64 * s)))
        hits = np.maximum(0.0, (hits - len(found) * self.rates) / np.maximum(1e-9, 1 - self.rates))
        if not hits.any():
            return self.fallback, 0.0
        best = int(hits.argmax())
        return self.languages[best], float(hits[best] / hits.sum())


def train(
    labelled: DataFrame, bits: int | None = None, probes: int = 4, sizes: tuple[int, ...] = (4,), held: int = 32 << 20
) -> LanguageFilter:
    """Learn from all rows of ``labelled`` (text, lang).

    The driver gets two numbers per language and the masks of the positions in use, at
    most ``held`` bytes. ``bits`` fixes the number of positions, ``1 << bits``.
    """
    labelled = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        docs: dict[str, int] = {}
        size = 0

        def write() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.nulls(len(gram), pa.int64())], names=["lang", "gram", "docs"],
                )
            held.clear()

        for batch in slices(batches, 1000):
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                found = grams(text, sizes)
                if found is not None:
                    held.setdefault(lang, []).append(found)
                    docs[lang] = docs.get(lang, 0) + 1
                    size += len(found)
            if size > 8_000_000:
                yield from write()
                size = 0
        yield from write()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(docs), type=pa.string()), pa.nulls(len(docs), pa.int64()), pa.array(list(docs.values()), type=pa.int64())],
            names=["lang", "gram", "docs"],
        )

    counted = labelled.mapInArrow(count, "lang string, gram bigint, docs bigint")
    summed = settle(counted.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "grams")
    per_language = summed.groupBy("lang").agg(F.sum("docs").alias("docs"), F.count("gram").alias("grams")).collect()
    totals = {r["lang"]: r["docs"] for r in per_language}
    languages = tuple(sorted(totals))
    slices_ = max(1, -(-len(languages) // 64))
    if bits is None:
        wanted = max([r["grams"] for r in per_language], default=0) * probes * 4
        bits = max(10, min(wanted.bit_length(), (held // (8 * slices_)).bit_length() - 1))
    places = np.zeros((slices_, 1 << bits), dtype=np.uint64)
    if languages:
        spark = labelled.sparkSession
        rows = [(lang, k // 64, 1 << k % 64 if k % 64 < 63 else -(1 << 63)) for k, lang in enumerate(languages)]
        known = spark.createDataFrame(rows, "lang string, slice int, mask bigint")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("gram").to_numpy().view(np.uint64)
                at = _positions(h, bits, probes).ravel()
                repeat = lambda c: np.repeat(batch.column(c).to_numpy(), probes)
                yield pa.RecordBatch.from_arrays([pa.array(repeat("slice")), pa.array(at), pa.array(repeat("mask"))], names=["slice", "position", "mask"])

        kept = summed.filter("gram IS NOT NULL").join(known, "lang")
        masks = kept.select("gram", "slice", "mask").mapInArrow(place, "slice int, position bigint, mask bigint")
        masks = masks.groupBy("slice", "position").agg(F.bit_or("mask").alias("mask")).toArrow()
        places[masks.column("slice").to_numpy(), masks.column("position").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(places[k // 64] & (np.uint64(1) << np.uint64(k % 64))) for k in range(len(languages))]) / (1 << bits)
    fallback = max(languages, key=lambda x: (totals[x], [-ord(c) for c in x])) if languages else "und"
    return LanguageFilter(languages, fallback, places, fill**probes, bits, probes, sizes)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score: one row per row of ``docs``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``held`` bytes of masks

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 1000):
            found = [own.decide(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(decide, "doc_id bigint, lang_pred string, score double")
