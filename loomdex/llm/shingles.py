"""Word shingles of texts as sorted arrays of 64-bit hashes, equal in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    """word -> hash, computed once per word; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """``width``-word shingle sets; texts of fewer than ``min_words`` words have none (None)."""

    def __init__(self, width: int, min_words: int):
        self.width, self.min_words, self.words = width, max(min_words, width), _Words()

    def __call__(self, title: str | None, body: str | None) -> np.ndarray | None:
        found = _WORD.findall(f"{title or ''} {body or ''}".lower())
        if len(found) < self.min_words:
            return None
        lookup = self.words
        h = np.fromiter([lookup[w] for w in found], dtype=np.uint64, count=len(found))
        n = len(h) - self.width + 1
        with np.errstate(over="ignore"):
            s = _mix(h[:n] + _M1)
            for i in range(1, self.width):
                s = _mix(s * _M1 + h[i : i + n])
        return np.unique(s)


def class_of(s: np.ndarray) -> int:
    """One hash of a whole set: equal sets have equal classes."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([np.add.reduce(s)], dtype=np.uint64) * _M1 + np.bitwise_xor.reduce(_mix(s)) + np.uint64(len(s)))[0])
