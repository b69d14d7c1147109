"""Elias-Fano coding of non-decreasing numbers, with vectorised successor search on mapped bytes.

Of each value the low bits are packed; the high parts become a bitmap with a one per value and a zero
after each bucket of equal high parts. A running count of ones per 64-bit word finds any zero, hence
where a bucket begins, without decoding.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_PLACE = np.array([[([b for b in range(8) if i >> b & 1] + [0] * 8)[r] for r in range(8)] for i in range(256)], np.uint8)
MAX_LOW = 57  # an unaligned 64-bit read holds any field of so many bits


def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one (from 0) of each word."""
    body = words.view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_ONES[body], axis=1, dtype=np.uint8)
    byte = (upto <= r[:, None]).sum(axis=1)
    at = np.arange(len(words))
    before = np.where(byte > 0, upto[at, byte - 1], 0)
    return byte * 8 + _PLACE[body[at, byte], r - before]


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.high = n, low_bits, high
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.fields = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 7,), (1,)) if n else None

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """Arrays to be stored; `values` are sorted unsigned 64-bit numbers."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(MAX_LOW, max(0, (top // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        place = high + np.arange(n)
        words = (int(place[-1]) if n else 0) // 64 + 2
        bits = np.zeros(words * 64, np.uint8)
        bits[place] = 1
        bitmap = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.zeros(words, np.uint32 if n < 1 << 32 else np.uint64)
        np.cumsum(np.bitwise_count(bitmap[:-1]), out=ones[1:])
        low = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        if low_bits:
            step = 1 << 15
            for i in range(0, n, step):  # a multiple of 8 values fills whole bytes
                part = ((values[i:i + step, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(part.ravel(), bitorder="little")
                low[i * low_bits // 8:i * low_bits // 8 + len(packed)] = packed
        return [np.array([n, low_bits], np.int64), low, bitmap, ones]

    @classmethod
    def mapped(cls, head: np.ndarray, low: np.ndarray, bitmap: np.ndarray, ones: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, bitmap, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.fields[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _in_word(~self.high[word], k - self.zeros[word])

    def successor(self, x: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first value >= x within [begin, end), or end; and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = 64 * len(self.high) - self.n - 1  # the last zero
        bucket = x >> np.uint64(self.low_bits)
        beyond = bucket > np.uint64(top)
        bucket = np.minimum(bucket, np.uint64(top)).astype(np.int64)
        first = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - np.maximum(bucket - 1, 0), 0)
        last = np.minimum(np.where(beyond, self.n, self._zero(bucket) - bucket), end)
        low, high = np.minimum(np.maximum(np.where(beyond, self.n, first), begin), end), last.copy()
        high = np.maximum(high, low)
        want = x & np.uint64((1 << self.low_bits) - 1)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self._low(middle) < want[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        found = (low < last) & ~beyond
        found[found] = self._low(low[found]) == want[found]
        return low, found

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values with numbers i."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        place = word * 64 + _in_word(self.high[word], i - ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)
