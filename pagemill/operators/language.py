"""Language identification by a naive Bayes model over character trigrams.

The profile is a long table with every trigram of every language and integer log
weights, so sums are exact and results do not depend on the order of addition. A
profile of measured size goes to every task, where a text's trigrams are scored as they
are read; a larger one meets the counted trigrams of all texts in a join.

Trigrams are counted and scored in Arrow batches by array operations, for a row per
trigram costs far more than the trigram's text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import has_words
from pagemill.operators.sizing import cut_lineage

MIN_WORDS = 20
# Code points whose trigrams are held at once.
PORTION = 1 << 20


def _letters(text: Column) -> Column:
    """The lower-cased text between blanks; runs of anything but letters count as one blank."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))


def _portions(texts: Iterable[tuple[int, str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The overlapping trigrams of numbered texts as integers, with the number of the text of each.

    Texts go through in portions of bounded size; a long text is cut into pieces that overlap by two characters.
    """
    numbers, pieces, size = [], [], 0
    for number, text in texts:
        for start in range(0, len(text or "") - 2, PORTION):
            numbers.append(number)
            pieces.append(text[start : start + PORTION + 2])
            size += len(pieces[-1])
            if size >= PORTION:
                yield _coded(numbers, pieces)
                numbers, pieces, size = [], [], 0
    if pieces:
        yield _coded(numbers, pieces)


def _coded(numbers: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    inside = np.ones(len(points), dtype=bool)
    ends = np.cumsum(lengths)
    inside[ends - 1] = inside[ends - 2] = False  # no trigram starts there
    codes = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside[:-2]]
    return codes, np.repeat(np.array(numbers, dtype=np.int64), lengths - 2)


def _written(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    whole = points.tobytes().decode("utf-32-le")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)]


def count_trigrams(df: DataFrame, text: str, by: str) -> DataFrame:
    """``(by, gram, n)``: how often each overlapping trigram of the lower-cased text occurs per value of a column."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).dictionary_encode()
            texts: dict[int | None, list[str | None]] = {}
            for place, letters in zip(values.indices.to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(place, []).append(letters)
            for place, some in texts.items():
                for codes, _ in _portions((0, t) for t in some):
                    grams, n = np.unique(codes, return_counts=True)
                    whose = pa.array([place] * len(grams), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [values.dictionary.take(whose), pa.array(_written(grams), pa.string()), pa.array(n, pa.int64())], [by, "gram", "n"]
                    )

    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    found = df.select(by, _letters(F.col(text)).alias("letters")).mapInArrow(counted, schema)
    return found.groupBy(by, "gram").agg(F.sum("n").alias("n"))


def train_profile(labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """Profile table ``(gram, language, weight)`` with every trigram seen.

    A weight is ``round(1000 * ln((count + 1) / (total + vocabulary)))``. The row of
    a language with the empty gram has the weight of the trigrams it lacks.
    """
    counts = cut_lineage(
        count_trigrams(labelled.where(F.col(label).isNotNull()), text, label).select(F.col(label).alias("language"), "gram", "n")
    )
    vocabulary = counts.select("gram").distinct().count()
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))

    def weight(n):
        return F.round(F.ln((n + 1) / (F.col("total") + F.lit(float(vocabulary)))) * 1000).cast("bigint").alias("weight")

    seen = counts.join(totals, "language").select("gram", "language", weight(F.col("n")))
    return seen.unionByName(totals.select(F.lit("").alias("gram"), "language", weight(F.lit(0))))


def detect_language(
    texts: DataFrame, profile: DataFrame, key: str, text: str = "body_text", in_memory: int = 64 << 20, in_columns: int = 64
) -> DataFrame:
    """``(key, language)`` for texts of at least 20 words that share a trigram with the profile.

    Shorter or unknown texts give no row. Ties go to the first language by name. The
    profile is measured: up to ``in_memory`` bytes and ``in_columns`` languages every task
    gets it whole, and a text's trigrams are scored where they are read, so that one row
    per text is exchanged. Beyond, texts and profile meet by trigram.
    """
    long_enough = texts.where(has_words(F.col(text), MIN_WORDS))
    bases = profile.where("gram = ''").select("language", "weight").orderBy("language").limit(in_columns + 1).collect()
    if len(bases) <= in_columns:
        size = profile.agg(F.approx_count_distinct("gram", 0.02)).first()[0] * (48 + 8 * len(bases))
        if 1.1 * size <= in_memory:
            return _score_in_task(long_enough, profile, key, text, {r["language"]: r["weight"] for r in bases})
    return _score_by_trigram(long_enough, profile, key, text)


def _score_in_task(texts: DataFrame, profile: DataFrame, key: str, text: str, bases: dict[str, int]) -> DataFrame:
    """Each trigram finds the gains of all languages in arrays that every task gets; one row per text is exchanged."""
    names = list(bases)
    gain = F.col("weight") - F.coalesce(*[F.when(F.col("language") == n, F.lit(bases[n])) for n in names]) if names else F.lit(0)
    each = [F.coalesce(F.sum(F.when(F.col("language") == n, gain)), F.lit(0)).cast("bigint").alias(f"gain{i}") for i, n in enumerate(names)]
    known = profile.where("gram <> ''").groupBy("gram").agg(F.count(F.lit(1)).alias("languages"), *each).drop("languages")
    known = known.where(F.length("gram") == 3).toArrow()
    codes = np.frombuffer("".join(known.column("gram").to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64).reshape(-1, 3)
    codes = codes[:, 0] << 42 | codes[:, 1] << 21 | codes[:, 2]
    gains = [known.column(f"gain{i}").to_numpy() for i in range(len(names))]
    columns = ["n", *[f"gain{i}" for i in range(len(names))]]

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pd.Index(codes)
        for batch in batches:
            sums = np.zeros((len(columns), batch.num_rows), dtype=np.int64)
            for found, rows in _portions(enumerate(batch.column(1).to_pylist())):
                at = places.get_indexer(found)
                at, rows = at[at >= 0], rows[at >= 0]
                sums[0] += np.bincount(rows, minlength=batch.num_rows)
                for i, gain in enumerate(gains, 1):
                    # Doubles hold these sums exactly: a portion's stay far below 2^53.
                    sums[i] += np.bincount(rows, gain[at], batch.num_rows).astype(np.int64)
            met = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(met)), *[pa.array(c[met]) for c in sums]], [key, *columns])

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in columns]])
    met = texts.select(key, _letters(F.col(text)).alias("letters")).mapInArrow(scored, schema)
    sums = met.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])
    losses = [F.struct((-(F.col(f"gain{i}") + F.col("n") * F.lit(bases[n]))).alias("loss"), F.lit(n).alias("language")) for i, n in enumerate(names)]
    best = F.array_min(F.array(*losses))["language"] if losses else F.lit(None).cast("string")
    return sums.select(key, best.alias("language"))


def _score_by_trigram(texts: DataFrame, profile: DataFrame, key: str, text: str) -> DataFrame:
    """For profiles of any size: trigrams are counted per text and join the profile by exchange."""
    counts = count_trigrams(texts, text, key)
    base = profile.where("gram = ''").select("language", F.col("weight").alias("base"))
    # Above what a language gives a trigram it lacks; never negative.
    gains = (
        profile.where("gram <> ''").join(base, "language")
        .groupBy("gram").agg(F.collect_list(F.struct("language", (F.col("weight") - F.col("base")).alias("gain"))).alias("gains"))
    )
    met = counts.join(gains, "gram").select(key, "n", F.posexplode("gains").alias("place", "entry"))
    sums = met.groupBy(key, F.col("entry.language").alias("language")).agg(
        F.sum(F.col("n") * F.col("entry.gain")).alias("gain"), F.sum(F.when(F.col("place") == 0, F.col("n")).otherwise(0)).alias("n")
    )
    whole = sums.join(base, "language").groupBy(key).agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("language", "gain", "base")).alias("found")
    )
    # Of the languages that a text shares nothing with, only the one with the highest base can win.
    rest = base.agg(F.min_by("language", F.struct((-F.col("base")).alias("b"), "language")).alias("r"), F.max("base").alias("rb"))
    whole = whole.withColumn("rest", F.struct(
        rest.select("r").scalar().alias("language"), F.lit(0).cast("bigint").alias("gain"), rest.select("rb").scalar().alias("base")
    ))
    known = F.exists("found", lambda x: x["language"] == F.col("rest.language"))
    scored = F.transform(
        F.when(known, F.col("found")).otherwise(F.concat("found", F.array("rest"))),
        lambda x: F.struct((-(x["gain"] + F.col("n") * x["base"])).alias("loss"), x["language"].alias("language")),
    )
    return whole.select(key, F.array_min(scored)["language"].alias("language"))
