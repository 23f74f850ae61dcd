"""Words and word shingles as 64-bit hashes, in numpy; helpers for Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S29, S32 = np.uint64(29), np.uint64(32)


def word_hashes(text: bytes | None) -> np.ndarray:
    """A hash for each word, in order. bytes.lower() and bytes.split() know ASCII only, as wanted: A-Z, and the six white-space bytes."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S29)) * P2
    return x ^ (x >> S32)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k successive words."""
    n = len(words) - k + 1
    s = words[:n] * P1
    for j in range(1, k):
        s = (s ^ (s >> S29)) * P1 + words[j : n + j]
    return mixed(s)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of k words; the whole sequence as one if there are fewer words; none if there are no words."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < k:
        return runs(w, len(w)) ^ np.uint64(len(w))
    return np.unique(runs(w, k))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class MinHasher:
    """size components of 16 bits each."""

    def __init__(self, size: int, seed: int = 7):
        self.mult = np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mult), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            np.minimum(least, np.multiply.outer(shingles[at : at + 1024], self.mult).min(axis=0), out=least)
        return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
