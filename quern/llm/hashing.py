"""Vectorised word hashing over Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WINDOW = 1 << 21
_POWERS = np.ones(1, U)
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64 bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), BASE, U)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each starts (null is empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and each text's first word's place.

    Hashes are polynomial in the bytes modulo 2**64, mixed with the length.
    """
    raw, at = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    gap = IS_SPACE[raw]
    first = at[:-1][at[:-1] < n]
    opens = np.empty(n, bool)
    opens[0] = True
    opens[1:] = gap[:-1]
    opens[first] = True
    closes = np.empty(n, bool)
    closes[-1] = True
    closes[:-1] = gap[1:]
    closes[first[first > 0] - 1] = True
    starts, ends = np.flatnonzero(opens & ~gap), np.flatnonzero(closes & ~gap) + 1
    out = np.empty(len(starts), U)
    low = 0
    while low < len(starts):  # a few megabytes at a time, cut between words
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + WINDOW)))
        a, b = starts[low], ends[high - 1]
        s = starts[low:high] - a
        within = np.arange(b - a) - np.repeat(s, np.diff(np.append(s, b - a)))
        longest = int((ends[low:high] - starts[low:high]).max())
        value = (LOWER[raw[a:b]].astype(U) + U(1)) * powers(longest)[np.minimum(within, longest - 1)]
        value[gap[a:b]] = 0
        out[low:high] = np.add.reduceat(value, s)
        low = high
    out += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(out), np.searchsorted(starts, at).astype(np.int64)


def slices(sizes: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``most``; one row may be more by itself."""
    total, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = int(np.searchsorted(total, total[low] + most, side="right")) - 1
        high = min(max(high, low + 1), low + rows, len(sizes))
        yield low, high
        low = high
