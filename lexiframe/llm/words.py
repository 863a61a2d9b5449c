"""Words of a text as 64-bit hashes, and hashes of every run of k words, in numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

# A worker forgets its cache beyond this many words (some 45 MB).
CACHE_WORDS = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
# Odd multipliers of the two independent rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, computed once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self._grow(1024)

    def _grow(self, n: int) -> None:
        self.up, self.down = (
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)])
            for b in (self.base, self.inverse)
        )

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self._grow(2 * n)
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of runs of words of one text; equal runs have equal hashes wherever they stand."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

    def runs(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` words, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each run [start, end); the length is part of it."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(value + mix((end - start).astype(np.uint64)))


def release_memory() -> None:
    """Give back what a worker has freed: it is kept for later tasks, and others need the memory meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run [start, start + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
