"""Elias-Fano sequences in flat bytes, searched and read by whole arrays of numbers."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the set bit number r (from 0) in each 64-bit word."""
    place, r = np.zeros(len(word), np.int64), r.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << step) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        above = r >= count
        r -= np.where(above, count, 0)
        word = np.where(above, word >> np.uint64(step), low)
        place += np.where(above, step, 0)
    return place


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, one after the other, in 64-bit words with one spare word."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (shift.astype(np.int64) + width) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def encode(values: np.ndarray) -> list[np.ndarray]:
    """Parts of a sequence that never falls: head (count, low bits), low parts, high bits, ones before each word of these."""
    values = values.astype(np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    low = max(int(most // max(n, 1)).bit_length() - 1, 0)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros((n + (most >> low) + 1 + 64) // 64 + 1, np.uint64)
    at = high + np.arange(n)
    np.bitwise_or.at(bits, at >> 6, _ONE << (at & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]).astype(np.uint32)
    return [np.array([n, low], np.uint64), _pack(values & np.uint64((1 << low) - 1), low), bits, ones]


class EliasFano:
    """Reads the parts of ``encode``; they may be views of a mapped file."""

    def __init__(self, head: np.ndarray, lows: np.ndarray, bits: np.ndarray, ones: np.ndarray):
        self.n, self.low = int(head[0]), int(head[1])
        self.lows, self.bits, self.ones = lows, bits, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        got = self.lows[word] >> shift
        more = np.where(shift > 0, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (got | more) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values number i (0 <= i < n)."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.bits[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below h."""
        out = np.full(len(h), self.n, np.int64)
        out[h <= 0] = 0
        inside = (h > 0) & (h <= self.zeros[-1])
        z = h[inside] - 1
        word = np.searchsorted(self.zeros, z, side="right") - 1
        place = word * 64 + _select_in_word(~self.bits[word], z - self.zeros[word])
        out[inside] = np.minimum(place - z, self.n)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Number of the first value that is at least x (n if none is): the high part gives a few neighbours, their low parts decide."""
        h = (x >> np.uint64(self.low)).astype(np.int64)
        lo, hi = self._bucket(h), self._bucket(h + 1)
        want = x & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo
