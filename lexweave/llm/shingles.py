r"""Sets of word shingles as 64-bit hashes.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased. A set holds the hashes of the distinct sequences of WIDTH
consecutive words, or of the whole sequence where there are fewer words; it is empty without words.
"""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

WIDTH = 5
#: Distinct words whose hashes a worker remembers, and bytes of one that is; the memory is emptied when full.
WORDS_HELD, LONGEST_HELD = 250_000, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_HELD:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = h
        return h


_words = common.remembered(_Words(), "parity_join", "suffix_tree", "shingles")


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x + np.array([seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1], dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of(raw: bytes) -> np.ndarray:
    """The sorted set of a text's UTF-8."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < WIDTH:
        total = np.array([len(h)], dtype=np.uint64)
        for i in range(len(h)):
            total = mixed(h[i : i + 1] * _ODD[i] + total)
        return total
    n = len(h) - WIDTH + 1
    s = h[:n] * _ODD[0]
    for i in range(1, WIDTH):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n] * _ODD[i]
    return np.unique(mixed(s))
