"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D of the text with A-Z lower-cased; a shingle is a run of
`width` words, and a text with fewer words is one shingle. Shingles are compared by 64-bit hashes: two different
shingles of one comparison agree by chance with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 0x7F4A7C15F39CC060 * 2 * i) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], dtype=np.uint64)
_WORDS_KEPT = 200_000


class WordHashes(dict):
    """Hash by word, kept for the words met again; emptied when it has grown to its limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; empty for null texts and texts without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(width, n)
    sums = w[: n - size + 1] * _MULTIPLIERS[0]
    for i in range(1, size):
        sums += w[i : n - size + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix(sums + np.uint64(size)))
