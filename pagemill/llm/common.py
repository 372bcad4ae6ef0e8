"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Translation of bytes that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z in lower case: bytes are cut at just these six characters."""
    return text.translate(LOWER).split()


def remainder(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of a batch that goes to Python, so that many long texts do not meet in one batch."""
    spark.conf.set(BATCH_BYTES, size)


class KeyCounts:
    """Counts of 64-bit keys, added up in sorted arrays of bounded size."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take in keys; yields what has to go out when there are too many."""
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > self.most:
                merged = self._merge()
                if len(merged[0]) > self.most // 2:
                    yield merged
                    self.parts, self.size = [], 0
                else:
                    self.parts, self.size = [merged], len(merged[0])

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self._merge()

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64)
