"""Word shingles as 64-bit hashes, for whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, which is what ``bytes.split()`` yields.
A text's set holds its distinct n-word shingles; a text with fewer words has its whole sequence as the one
element; a text without words, or a null, has an empty set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Odd 64-bit multipliers of the two mixing steps (the published splitmix64 finalizer).
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when it has ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode().lower().split() if text else []
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of ``n`` words; ``n`` is part of the hash."""
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h + STEP) + words[k : len(words) - n + 1 + k]
    return mix(h)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A text's shingles, repeats included: windows of ``n`` words, or all words as one if they are fewer."""
    return ngrams(words, min(n, len(words))) if len(words) else words


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(word_hashes(text), n))


def blocks(sets: Iterable[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Group consecutive arrays into lists of about ``size`` elements."""
    out, total = [], 0
    for s in sets:
        out.append(s)
        total += len(s)
        if total >= size:
            yield out
            out, total = [], 0
    if out:
        yield out
