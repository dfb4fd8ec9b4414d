"""Vectorised work on texts inside tasks: words, shingles and their hashes with numpy."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes in one Arrow batch (texts can be long), for the session's later queries."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > size:
        spark.conf.set(_BATCH, str(size))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.array([1], dtype=np.uint64)
_inverses = np.array([1], dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) >= n:
        return
    n = max(n, 2 * len(_powers), 1 << 14)
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    p, q = np.full(n, base), np.full(n, inverse)
    p[0] = q[0] = 1
    _powers, _inverses = np.cumprod(p), np.cumprod(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hashes' base, and of its inverse."""
    _grow(n)
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, in order."""
    words = text.lower().split()  # of bytes: A-Z only, and at those six
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; of the whole sequence where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + words[i : len(words) - n + 1 + i]
    return mixed(out + np.uint64(n))
