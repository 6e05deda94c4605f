"""64-bit hashes of any substrings of a text from one pass of prefix sums."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, mod 2**64."""
    if len(_tables[0]) < n:
        size = max(2 * n, 1 << 16)
        for k, factor in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    return _tables


class Rolling:
    """Polynomial prefix sums of a byte array; equal substrings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length))
