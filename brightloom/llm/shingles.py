"""Word shingles of whole texts as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task keeps; beyond, it starts anew.
KEPT_WORDS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words; each task has its own, so they go with it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space: bytes.lower and bytes.split know ASCII alone."""
    return text.encode().lower().split()


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width codes."""
    h = codes[: len(codes) - width + 1].copy()
    for k in range(1, width):
        h = h * _P + codes[k : len(codes) - width + 1 + k]
    return mixed(h + np.uint64(width))


def shingle_set(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """Distinct shingles, ascending; the whole sequence as one if it is shorter, none without words."""
    words = words_of(text) if text else []
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not words:
        return codes
    return np.unique(windows(codes, min(width, len(words))))
