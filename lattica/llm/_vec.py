"""Vectorised words, hashes and windows over the bytes of a batch of texts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[o[0]: o[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, o - o[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of words before it (n + 1 values)."""
    inside = ~space[buf]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    after[:-1], after[-1] = inside[1:], False
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    before[cut] = False
    after[cut - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U) * U(BASE) + U(1))
    at, own = starts, None
    left = length
    while len(left):
        take = np.minimum(left, 8).astype(U)
        part = eight[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - take * U(8)))
        if own is None:
            h = mix(h ^ part)
            own = np.flatnonzero(left > 8)
        else:
            h[own] = mix(h[own] * U(BASE) ^ part)
            own = own[left > 8]
        more = left > 8
        at, left = at[more] + 8, left[more] - 8
    return h


_TABLES: dict[int, np.ndarray] = {}


def power_table(n: int, base: int) -> np.ndarray:
    """Powers 0 .. n of base; the longest so far is kept."""
    if base not in _TABLES or len(_TABLES[base]) <= n:
        out = np.full(max(n, 1 << 16) + 1, U(base))
        out[0] = U(1)
        _TABLES[base] = np.cumprod(out, dtype=U)
    return _TABLES[base][: n + 1]


class Ranges:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.power = power_table(n, BASE)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * power_table(n, INV)[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start] + (end - start).astype(U))

    def windows(self, k: int) -> np.ndarray:
        """Of all windows of k values."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.power[:n] + U(k)) if n > 0 else np.empty(0, U)


def leftmost_min(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the leftmost of those whose upper halves are smallest."""
    if len(h) < w:
        return np.empty(0, np.int64)
    v, have = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), 1
    while have < w:
        step = min(have, w - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return (v & U(0xFFFFFFFF)).view(np.int64)
