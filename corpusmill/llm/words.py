"""Words of a text as 64-bit hashes, and Rabin-Karp hashes of word sequences in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CACHE_WORDS = 250_000


class WordHashes(dict):
    """xxHash-64 of words (bytes), remembered up to ``CACHE_WORDS`` at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def split(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` splits at exactly these six characters."""
    return text.split()


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            at = U(pow(BASE, m, 1 << 64)), U(pow(INVERSE, m, 1 << 64))
            self.up, self.down = (np.concatenate([a, a * x]) for a, x in zip((self.up, self.down), at))
        return self.up[:n], self.down[:n]


class Rolling:
    """Rabin-Karp hashes of any run of words, from prefix sums modulo 2**64.

    The hash of words s..e-1 is the sum of hash(word s+j) * BASE**-j, the same wherever
    the run stands.
    """

    def __init__(self, hashes: np.ndarray, powers: Powers):
        self.up, down = powers.get(len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * down[:-1], dtype=U)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))

    def every(self, n: int) -> np.ndarray:
        """Of each run of n words."""
        m = max(0, len(self.sums) - n)
        return mix((self.sums[n : n + m] - self.sums[:m]) * self.up[:m] + U(n))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    m, have = x, 1
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m
