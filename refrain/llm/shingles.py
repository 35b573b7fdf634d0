"""Word shingles as hashes, and circulant MinHash signatures of their sets."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words that a worker keeps the hashes of, at most.
KEEP_WORDS = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met most lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; with fewer words, of the whole sequence; without, nothing."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mix64(np.array([_chain([words[i : i + 1] for i in range(n)])[0] + np.uint64(n)], np.uint64))
    found = _chain([words[i : n - width + 1 + i] for i in range(width)])
    found = np.sort(mix64(found + np.uint64(width)))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    total = parts[0]
    for part in parts[1:]:
        total = mix64(total * ODD) + part
    return total


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes, which is not empty.

    A first permutation scatters the elements over 2**32 places; coordinate k is the least value that a second one,
    shifted by k places, gives to any of them. Two permutations thus yield every coordinate.
    """
    places = (mix64(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(least, mix32(places[None, at : at + 512] + shifts).min(axis=1), out=least)
    return least
