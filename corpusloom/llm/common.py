"""What several of the operators here share: bounded batches, word ids, row choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS_A_BATCH = 4_000_000


def latest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """One row for each ``key``, the last by the columns ``by`` (nulls first); rows without a key go.

    A repeated row may stay in any of its copies. The aggregate combines on the map side,
    so a key that holds a third of all rows moves one row a task.
    """
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*by)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "_row.*")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHARS_A_BATCH) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that no Python worker holds a whole Arrow batch of long texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordIds(dict):
    """word -> 63-bit hash, remembered; forgotten when it holds too many words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


__all__ = ["latest", "slices", "WordIds", "mix", "lists", "Window"]
