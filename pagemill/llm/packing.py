"""Packing by the sum-of-squares rule.

Each task tokenises its documents and packs them online. A document longer than a
window gives full windows first; what is left goes, uncut, to the fill level that
makes the sum over levels of (number of open windows at that level) squared least.
The counts are one array indexed by level. When a task ends, the windows still open
are run together and cut at window ends, and the last cut is at powers of two,
where sequences need no padding. Nothing is shuffled; a lost task is repeated with
the same result, since sequence ids derive from the partition number.

Defined results: a null text is empty and gives the separator alone. Repeated rows
are packed each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagemill.llm.common import slices, texts

# How a byte-level BPE file cuts text, and its one special token.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPECIAL = "<|endoftext|>"


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE JSON file.

    Its ids are those of ``tokenizers`` (the tests compare them) at six times the speed.
    Ids follow the order of merges in such files, which is what ranks need.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    letters, vocab = _letter_bytes(), dict(model["model"]["vocab"])
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class LevelPacker:
    """Online sum-of-squares packing of pieces into windows of ``size`` tokens.

    A window is a list of (document, start, ids). ``counts[h]`` is the number of open windows filled to h.
    """

    def __init__(self, size: int) -> None:
        self.size, self.counts = size, np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, piece: tuple) -> list | None:
        """Put one piece of at most ``size`` ids into a window; the window, if that filled it."""
        n = len(piece[2])
        if n == self.size:
            return [piece]
        # A new window adds one at level n; an open one at level h leaves h and, unless it is full then, joins h + n.
        after = 2 * self.counts[n:] + 1
        after[-1] = 0
        change = after.copy()
        change[1:] += 1 - 2 * self.counts[1:self.size - n + 1]
        usable = self.counts[:self.size - n + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + n == self.size:
            return window
        self.counts[level + n] += 1
        self.open[level + n].append(window)
        return None

    def close(self) -> Iterator[list]:
        """What is open, run together and cut anew; the tail at powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], min(self.size, 1 << (left.bit_length() - 1)) if left else 0
        for document, start, ids in pieces:
            while len(ids):
                take = ids[:room]
                window.append((document, start, take))
                start, ids, room, left = start + len(take), ids[len(take):], room - len(take), left - len(take)
                if not room:
                    yield window
                    window, room = [], min(self.size, 1 << (left.bit_length() - 1)) if left else 0


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 1) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode
        packer, sequence = LevelPacker(size), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def write(window: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, total), start, ids in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

        for batch in slices(batches, 500):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.array([*encode(text, allowed_special="all"), separator], dtype="<u4")
                for start in range(0, len(ids), size):
                    window = packer.place(((doc_id, len(ids)), start, ids[start:start + size]))
                    if window:
                        write(window)
            yield flush()
        for window in packer.close():
            write(window)
        yield flush()

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)
