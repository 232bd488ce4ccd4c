"""64-bit hashes of words, word n-grams and byte strings, for all positions of a chunk of texts at once.

A polynomial over the positions modulo 2**64 with an odd base: its prefix sums give the hash of any span, as odd numbers
have inverses. What comes out is mixed, so that every bit depends on every other.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, for i from 0 to n at least; kept for the next call."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Spans:
    """Hashes of any spans of a sequence of integers."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.up, self.down = powers(len(values) + 1, base)
        self.sums = np.empty(len(values) + 1, U)
        self.sums[0] = 0
        np.cumsum((values.astype(U) + U(1)) * self.up[: len(values)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) for each pair; spans of different lengths differ as well."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ mix((end - start).astype(U)))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all spans of length k, in order."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words in a chunk: byte places, and for each text its first word (one more at the end)."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~separators[buf]
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    if len(values) < w:
        return values[:0]
    done, out = 1, values
    while 2 * done <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(values) - w + 1], out[w - done : w - done + len(values) - w + 1]) if done < w else out


def runs(same: np.ndarray) -> np.ndarray:
    """Starts of runs: same[i] says that i + 1 belongs with i."""
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All starts[i] + 0 .. lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of n places, whether a span covers it."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
