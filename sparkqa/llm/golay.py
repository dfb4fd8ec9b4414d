"""The binary Golay code of length 23: every word lies within three bits of exactly one of its 4096 codewords.

``keys`` gives the codewords within four bits of a word: the one it decodes to and, where that is three bits away, five
more. Two words that differ in at most one bit always share one of these keys.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS = 23


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of words (as polynomials) by the generator."""
    rest = words.astype(np.int64)
    for i in range(BITS - 1, 10, -1):
        rest = np.where(rest >> i & 1, rest ^ GENERATOR << (i - 11), rest)
    return rest


def _tables() -> np.ndarray:
    """Error patterns by syndrome, -1 where there are fewer than six."""
    out = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(BITS), weight)], dtype=np.int64)
        for pattern, s in zip(patterns.tolist(), syndrome(patterns).tolist(), strict=True):
            out[s, used[s]] = pattern
            used[s] += 1
    return out


ERRORS = _tables()


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) numbers from 0 to 4095 of the codewords near each word; -1 where there is none."""
    errors = ERRORS[syndrome(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> 11)
