"""Polynomial prefix hashes over byte blocks, modulo 2**64.

The prefix hash of n bytes is the sum of ``weight[byte_j] * BASE**j``. The hash of a span is a difference of
two prefix hashes, times the inverse power of its start, so equal spans have equal hashes wherever they are.
"""

from __future__ import annotations

import numpy as np

#: An odd base for each of two independent hashes, and the multipliers of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX_1
    h ^= h >> np.uint64(33)
    h *= MIX_2
    h ^= h >> np.uint64(33)
    return h


def weights(which: int) -> np.ndarray:
    """A 64-bit weight for each byte value."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * which)) * np.uint64(BASES[1 - which]))


WEIGHTS = (weights(0), weights(1))


def powers(base: int, count: int) -> np.ndarray:
    """``base**0`` to ``base**(count - 1)``."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        size = 1 << max(12, (count - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known, dtype=np.uint64)
    return known[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class PrefixHash:
    """Span hashes of a block of bytes."""

    def __init__(self, block: np.ndarray, which: int = 0):
        self.base = BASES[which]
        self.sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(WEIGHTS[which][block] * powers(self.base, len(block)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans from ``start`` to ``end``."""
        back = powers(inverse(self.base), len(self.sums))
        return (self.sums[end] - self.sums[start]) * back[start]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size, in order."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        out = self.sums[size:] - self.sums[:-size]
        out *= powers(inverse(self.base), len(out))
        return out
