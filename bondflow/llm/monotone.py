"""Elias-Fano sequences in memory-mapped files, with vectorised access and search."""

from __future__ import annotations

import os
import uuid

import numpy as np

_PAD = 8
_ONE = np.uint64(1)


def _save(path: str, array: np.ndarray) -> None:
    """Writes a file at once: another attempt of the same task may write it too."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def build(path: str, values: np.ndarray, universe: int) -> None:
    """Writes sorted values below universe to path.*.npy: `low` bits packed, `upper` bits in unary, and counts of zeros and ones before each word."""
    n = len(values)
    width = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
    high = (values >> np.uint64(width)).astype(np.int64)
    top = int(universe >> width) + 1
    bits = np.zeros((n + top + 63) // 64 * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])[:-1]
    zeros = 64 * np.arange(len(upper), dtype=np.int64) - ones
    low = []
    for first in range(0, n if width else 0, 1 << 16):
        part = values[first : first + (1 << 16), None] >> np.arange(width, dtype=np.uint64) & _ONE
        low.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
    low.append(np.zeros(_PAD, np.uint8))
    for name, array in (("low", np.concatenate(low)), ("upper", upper), ("ones", ones), ("zeros", zeros), ("shape", np.array([n, width, top]))):
        _save(f"{path}.{name}.npy", array)


class Monotone:
    def __init__(self, path: str):
        self.low, self.upper, self.ones, self.zeros = (np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "upper", "ones", "zeros"))
        self.n, self.width, self.top = (int(x) for x in np.load(f"{path}.shape.npy"))
        self.mask = np.uint64((1 << self.width) - 1)
        self.eights = np.ndarray((len(self.low) - _PAD + 1,), np.uint64, self.low, strides=(1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return self.eights[at >> 3] >> (at & 7).astype(np.uint64) & self.mask

    @staticmethod
    def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word."""
        place = np.zeros(len(word), np.uint64)
        k = k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            over = k >= n
            k -= np.where(over, n, 0)
            step = np.where(over, np.uint64(half), np.uint64(0))
            place += step
            word = word >> step
        return place.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the upper bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return 64 * word + self._select(~self.upper[word], k - self.zeros[word])

    def value(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = 64 * word + self._select(self.upper[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Places of the values, -1 for those not held; looks between first and end if these are given."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(high < self.top)
        high, target = high[inside], values[inside] & self.mask
        low = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - high + 1, 0)
        high = self._zero(high) - high
        if first is not None:
            low, high = np.maximum(low, first[inside]), np.minimum(high, end[inside])
        stop = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < target[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        there = np.flatnonzero(low < stop)
        there = there[self._low(low[there]) == target[there]]
        out[inside[there]] = low[there]
        return out
