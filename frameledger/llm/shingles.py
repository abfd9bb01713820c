"""Hashed word shingles and MinHash sketches of whole texts."""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

#: Odd multipliers (the fractions of square roots of primes), fixed values.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordTable:
    """64-bit hashes of the distinct words met. It starts anew beyond most entries."""

    def __init__(self, most: int = 120_000):
        self.most, self.code, self.hash = most, {}, array("Q")

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word in order, and the number of words of each text. A-Z is lower-cased."""
        split = [t.lower().split() for t in texts]
        if len(self.code) > self.most:
            self.code, self.hash = {}, array("Q")
        for w in set().union(*split) - self.code.keys():
            self.code[w] = len(self.hash)
            self.hash.append(xxhash.xxh64_intdigest(w))
        n = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        return (np.frombuffer(self.hash, np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)), n


@lru_cache(1)
def word_table() -> WordTable:
    return WordTable()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; with fewer words than width the whole sequence is one."""
    word, n = word_table().words(texts)
    out, at = [], 0
    for count in n.tolist():
        own = word[at : at + count]
        at += count
        if not count:
            out.append(np.zeros(0, np.uint64))
            continue
        size = min(width, count)
        total = np.full(count - size + 1, size, np.uint64)
        for i in range(size):
            total = mixed(total ^ own[i : count - size + 1 + i])
        out.append(np.unique(total))
    return out


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """len(sets) x count matrix of 32-bit minima; rows of empty sets are all ones."""
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    own = [i for i, s in enumerate(sets) if len(s)]
    if not own:
        return out
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    flip = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
    shift = np.uint32(15)
    for first in range(0, len(own), 64):
        some = own[first : first + 64]
        flat = np.concatenate([sets[i] for i in some])
        flat = (flat >> np.uint64(32)).astype(np.uint32)
        size = np.fromiter((len(sets[i]) for i in some), np.int64, len(some))
        start = np.cumsum(size) - size
        for k in range(count):
            x = (flat ^ flip[k]) * factor[k]
            x ^= x >> shift
            x *= np.uint32(0x2C1B3C6D)
            out[some, k] = np.minimum.reduceat(x, start)
    return out
