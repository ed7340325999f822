"""Words and word shingles of a text, as 64-bit hashes.

Words: A-Z lower-cased, runs of bytes other than 0x20 and 0x09-0x0D. A null text has no words.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
MASK = (1 << 64) - 1
#: Words whose hashes a task keeps at most; others are hashed anew.
CACHED_WORDS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, salt: int, kind: type = np.uint64) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)).astype(kind) | kind(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


class Shingler:
    """Distinct shingle hashes of texts. With fewer words than a shingle takes, the whole sequence is one shingle; without words there is none."""

    def __init__(self, size: int = WORDS_PER_SHINGLE):
        self.size, self.hashes, self.factors = size, WordHashes(), odd_numbers(size, 11)

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def sequence(self, text: str | None) -> np.ndarray:
        """Shingle hashes in order, repeats included."""
        words = self.words(text)
        n = min(len(words), self.size)
        if not n:
            return words
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out += words[i : len(words) - n + 1 + i] * self.factors[i]
        return mix(out)

    def distinct(self, text: str | None) -> np.ndarray:
        """Sorted."""
        found = self.sequence(text)
        found.sort()
        return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
