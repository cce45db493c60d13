"""Word shingles of texts as sorted sets of 64-bit hashes, for use inside Arrow batches."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

CACHED_WORDS = 200_000  # word hashes a task keeps; it only saves time
_K = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    """Hashes by word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Shingles of ``width`` words. A-Z count as lower case; words are what ASCII white space separates.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.known = _Known()

    def words(self, text: str | bytes) -> np.ndarray:
        """Hash of every word, in order."""
        text = text.encode() if isinstance(text, str) else text
        words = text.lower().split()  # bytes: lower() and split() know ASCII only
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def over(self, words: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles of a sequence of word hashes."""
        n = len(words)
        if not n:
            return words
        width = min(self.width, n)
        h = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            h = h * _K + words[k : n - width + 1 + k]
        return np.unique(mixed(h))

    def __call__(self, text: str) -> np.ndarray:
        return self.over(self.words(text))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart."""
    data = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    """Band hashes of a one-permutation MinHash; bands without any value are left out."""
    bins = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(bins, (shingles % np.uint64(bands * rows)).astype(np.int64), shingles)
    table = bins.reshape(bands, rows)
    filled = (table != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = h * _K + table[:, k]
    return mixed(h).view(np.int64)[filled].tolist()
