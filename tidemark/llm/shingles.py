"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SIZE = 5
#: Distinct words that a task remembers before it starts afresh.
MEMORY = 65_536
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SIZE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, in order."""
    found = (text or "").encode().lower().split()
    return np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))


def window_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hash of every run of size words; of fewer words, one hash for all of them; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += words[k : n - width + 1 + k] * _FACTORS[k]
        return mix(out)


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(window_hashes(word_hashes(t))) for t in texts.to_pylist()]
