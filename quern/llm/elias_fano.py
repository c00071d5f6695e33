"""Elias-Fano sequences: monotone integers in compact arrays that can be memory-mapped."""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE, MASK6, ALL = U(1), U(63), U(0xFFFFFFFFFFFFFFFF)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each in 64-bit words, one spare word at the end."""
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width and len(values):
        at = np.arange(len(values), dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & MASK6
        np.bitwise_or.at(out, word, values << shift)
        over = shift + U(width) > U(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U)
    place = at.astype(U) * U(width)
    word, shift = (place >> U(6)).astype(np.int64), place & MASK6
    low, high = words[word] >> shift, np.where(shift > 0, words[word + 1] << ((U(64) - shift) & MASK6), U(0))
    return (low | high) & (ALL >> U(64 - width))


class EliasFano:
    """A non-decreasing sequence of n integers below 2**63.

    The low bits are packed; the high parts are unary in a bit array with a count of ones before each word.
    ``words`` holds it all in one array of 64-bit words, so a level can be written, mapped and read in place.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n, self.width, self.buckets, lows, highs = (int(x) for x in words[:5])
        self.low = words[5 : 5 + lows]
        self.high = words[5 + lows : 5 + lows + highs]
        self.ones = words[5 + lows + highs : 5 + lows + 2 * highs]

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        part = (values >> U(width)).astype(np.int64)
        buckets = (top >> width) + 1
        bits = np.zeros(-(-(n + buckets + 1) // 64) * 64, np.uint8)
        bits[part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        low = pack(values & (ALL >> U(64 - width)) if width else np.zeros(n, U), width)
        counts = np.bitwise_count(high).astype(U)
        ones = np.cumsum(counts) - counts
        return cls(np.concatenate([np.array([n, width, buckets, len(low), len(high)], U), low, high, ones.astype(U)]))

    @staticmethod
    def _within(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of the set bit with ``rank`` set bits below it, by halving."""
        place, left = np.zeros(len(word), U), rank.astype(U)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count((word >> place) & (ALL >> U(64 - half))).astype(U)
            go = left >= below
            left = np.where(go, left - below, left)
            place = np.where(go, place + U(half), place)
        return place.astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        at = at.astype(np.int64)
        word = np.searchsorted(self.ones, at.astype(U), side="right") - 1
        bit = word * 64 + self._within(self.high[word], at - self.ones[word].astype(np.int64))
        return ((bit - at).astype(U) << U(self.width)) | unpack(self.low, self.width, at)

    def _bucket(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``part``: the ones before the part-th zero."""
        zeros = np.arange(len(self.ones), dtype=U) * U(64) - self.ones
        want = np.maximum(part - 1, 0).astype(U)
        word = np.searchsorted(zeros, want, side="right") - 1
        bit = word * 64 + self._within(~self.high[word], want - zeros[word])
        return np.where(part == 0, 0, bit - part + 1)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is at least the given one; n if there is none."""
        values = values.astype(U)
        part = np.minimum(values >> U(self.width), U(self.buckets)).astype(np.int64)
        place, end = self._bucket(part), self._bucket(np.minimum(part + 1, self.buckets))
        end = np.where(part >= self.buckets, place, end)
        want = values & (ALL >> U(64 - self.width)) if self.width else np.zeros(len(values), U)
        open_ = np.flatnonzero(place < end)
        while len(open_):  # halve each bucket's range
            middle = (place[open_] + end[open_]) >> 1
            less = unpack(self.low, self.width, middle) < want[open_]
            place[open_] = np.where(less, middle + 1, place[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[place[open_] < end[open_]]
        return place
