"""Words of whole texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words are runs of anything but space, \t, \n, \v, \f and \r; bytes.split() without arguments cuts exactly there.
MIX = np.uint64(0x9E3779B97F4A7C15)
CACHE = 400_000


class WordHashes(dict):
    """Word (bytes) to hash; remembers the first CACHE words only, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


def lowered(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case (other letters stay); none for null."""
    return text.lower().split() if text else []


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread hashes over all 64 bits (the finaliser of a well-known mixing function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, gap: int = 0) -> np.ndarray:
    """Hashes of n words in a row, or with gap > 0 of two words that have gap words between them."""
    if gap:
        return scramble(h[: -gap - 1] * MIX + h[gap + 1 :] + np.uint64(gap)) if len(h) > gap + 1 else h[:0]
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = out * MIX + h[i : len(h) - n + 1 + i]
    return scramble(out) if n > 1 else out
