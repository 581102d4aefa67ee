"""External induced sorting: the order of all suffixes of a string on disk, in memory of a stated number of entries.

``Heap`` is a priority queue of suffix tuples (key, turn, place): what doesn't fit waits in sorted runs on disk.  ``induce``
sorts all suffixes from sorted (or, for a first pass, unsorted) LMS suffixes, those that start a descent-then-ascent: two
scans in order of the queue, in which each suffix puts in the one that starts a symbol earlier.  ``lms_order`` names LMS
substrings from a first pass, and recurses on the string of names while names repeat, until a string fits in memory.

Scans take as many entries from the queue at a time as nothing they put in could come before.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

_END = (1 << 62, 1 << 62)


def zeros(folder: str, n: int, limit: int, kind=np.int64) -> np.ndarray:
    """n zeros, in a file of their own if they are more than ``limit``."""
    if n <= limit:
        return np.zeros(n, kind)
    return np.memmap(tempfile.mktemp(dir=folder), kind, "w+", shape=(max(n, 1),))[:n]


class Column:
    """Numbers appended to a file, then read as an array."""

    def __init__(self, folder: str, kind=np.int64):
        self.path, self.kind, self.n = tempfile.mktemp(dir=folder), kind, 0
        self.file = open(self.path, "wb")

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.n += len(values)

    def read(self) -> np.ndarray:
        self.file.close()
        return np.memmap(self.path, self.kind, "r", shape=(self.n,)) if self.n else np.empty(0, self.kind)


def blocks(values: np.ndarray, size: int, backward: bool = False) -> Iterator[np.ndarray]:
    n = len(values)
    for a in range(0, n, size):
        yield np.asarray(values[max(0, n - a - size): n - a])[::-1] if backward else np.asarray(values[a: a + size])


class Heap:
    """Disk-backed priority queue of (key, turn, place), the smallest (key, turn) first; ``limit`` entries in memory or so."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, max(limit, 4)
        self.step = max(2, self.limit // 8)
        self.runs: list[list] = []  # arrays of three columns, and how much of each is gone
        self.far: list[np.ndarray] = []
        self.n_far = 0
        self.near, self.new = np.empty((0, 3), np.int64), []
        self.bound = (-_END[0], 0)  # smaller entries are near

    @staticmethod
    def _sorted(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def push(self, key: np.ndarray, turn: np.ndarray, place: np.ndarray) -> None:
        rows = np.stack([key, turn, place], 1).astype(np.int64)
        k, t = self.bound
        near = (rows[:, 0] < k) | ((rows[:, 0] == k) & (rows[:, 1] < t))
        if near.any():
            self.new.append(rows[near])
            rows = rows[~near]
        if len(rows):
            self.far.append(rows)
            self.n_far += len(rows)
            if self.n_far >= self.limit:
                self._spill()

    def _spill(self) -> None:
        path = tempfile.mktemp(dir=self.folder)
        self._sorted(np.concatenate(self.far)).tofile(path)
        self.runs.append([np.memmap(path, np.int64, "r", shape=(self.n_far, 3)), 0, path])
        self.far, self.n_far = [], 0

    def _advance(self) -> None:
        rest = [self._sorted(np.concatenate(self.far)), 0, None] if self.far else None
        sources = [*self.runs, rest] if rest else self.runs
        if not sources:
            return
        per = max(2, self.step // len(sources))
        heads = [np.asarray(rows[at: at + per]) for rows, at, _ in sources]
        cut = [tuple(h[-1, :2].tolist()) for h, (rows, at, _) in zip(heads, sources) if at + per < len(rows)]
        self.bound = min(cut) if cut else (max(int(h[-1, 0]) for h in heads) + 1, -_END[0])
        k, t = self.bound
        took = []
        for source, h in zip(sources, heads):
            own = int(((h[:, 0] < k) | ((h[:, 0] == k) & (h[:, 1] < t))).sum())
            took.append(h[:own])
            source[1] += own
        for rows, at, path in self.runs:
            if at == len(rows):
                os.unlink(path)
        self.runs = [s for s in self.runs if s[1] < len(s[0])]
        if rest:
            left = rest[0][rest[1]:]
            self.far, self.n_far = ([left], len(left)) if len(left) else ([], 0)
        self.near = self._sorted(np.concatenate(took))

    def peek(self) -> np.ndarray | None:
        """The next entries, in order: all that are near, none if the queue is empty."""
        if self.new:
            self.near, self.new = self._sorted(np.concatenate([self.near, *self.new])), []
        while not len(self.near):
            if not self.runs and not self.far:
                return None
            self._advance()
        return self.near

    def take(self, n: int) -> None:
        self.near = self.near[n:]


def lms_of(s: np.ndarray, folder: str, limit: int) -> np.ndarray:
    """Places of LMS suffixes, ascending; the last symbol's, the end, is one if a larger symbol stands before it."""
    n = sum(len(x) for x in _lms_blocks(s, limit))
    out, at = zeros(folder, n, limit, np.uint32 if len(s) < 1 << 32 else np.int64), n
    for found in _lms_blocks(s, limit):
        out[at - len(found): at] = found
        at -= len(found)
    return out


def _lms_blocks(s: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    n, rising, size = len(s), True, max(limit, 2)  # rising: of the symbol after the block
    for b in range(n, 0, -size):
        a = max(0, b - size)
        own = np.asarray(s[max(a - 1, 0): min(b + 1, n)]).astype(np.int64)
        x = own[1:] if a else own  # from a on
        step = np.sign(np.diff(x)) if b < n else np.append(np.sign(np.diff(x)), 1)  # the end counts as rising
        place = np.where(step != 0, np.arange(len(step)), len(step))
        following = np.minimum.accumulate(place[::-1])[::-1]
        up = np.append(step > 0, rising)[following]
        before = np.append(x[:1] if not a else own[:1], x[: len(step) - 1])
        yield np.flatnonzero(up & (before > x[: len(step)])) + a
        rising = bool(up[0])


def _scan(heap: Heap, s: np.ndarray, sign: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (key, place, symbol before or -1) in order; each puts in its predecessor where that is of the scan's type.  Keys
    are sign * (2 * symbol + 1 for S suffixes); the end has the key -1."""
    turn = 0
    while (rows := heap.peek()) is not None:
        rows = rows[: heap.step]
        key, place = rows[:, 0], rows[:, 2]
        before = np.where(place > 0, s[np.maximum(place - 1, 0)].astype(np.int64), -1)
        symbol = s[place].astype(np.int64)
        odd = (key & 1) == 1
        if sign > 0:  # L suffixes from the smallest on
            puts = (before > symbol) | ((before == symbol) & ~odd)
            target = 2 * before
        else:
            puts = (before >= 0) & ((before < symbol) | ((before == symbol) & odd))
            target = -(2 * before + 1)
        least = np.minimum.accumulate(np.where(puts, target, _END[0]))
        late = np.flatnonzero(least[:-1] < key[1:])
        n = int(late[0]) + 1 if len(late) else len(key)
        heap.take(n)
        yield key[:n], place[:n], before[:n]
        own = np.flatnonzero(puts[:n])
        if len(own):
            heap.push(target[own], turn + own, place[own] - 1)
        turn += n


def induce(s: np.ndarray, seeds: np.ndarray, folder: str, limit: int, whole: bool) -> np.ndarray:
    """All suffixes of s (or the LMS ones alone) in descending order, from the LMS suffixes in ascending order; without that
    order, LMS suffixes come out by their LMS substrings.  The last symbol is the end: smaller than any other."""
    n, heap, turn = len(s), Heap(folder, limit), 0
    for p in blocks(seeds, limit):
        p = p.astype(np.int64)
        key = np.where(p == n - 1, -1, 2 * s[p].astype(np.int64) + 1)
        heap.push(key, turn + np.arange(len(p)), p)
        turn += len(p)
    falling = Column(folder)
    if not len(seeds) or n - 1 not in seeds[-1:] and n - 1 not in seeds[:1]:
        heap.push(np.array([-1]), np.array([0]), np.array([n - 1]))  # the end, where it isn't LMS
    for key, place, _ in _scan(heap, s, 1, limit):
        falling.add(place[(key & 1) == 0])
    falling = falling.read()
    heap, turn, out = Heap(folder, limit), 0, Column(folder)
    for p in blocks(falling, limit, backward=True):
        heap.push(-2 * s[p].astype(np.int64), turn + np.arange(len(p)), p)
        turn += len(p)
    for key, place, before in _scan(heap, s, -1, limit):
        out.add(place if whole else place[((key & 1) == 1) & (before > s[place])])
    out.add(np.array([n - 1]))
    return out.read()


def _named(s: np.ndarray, lms: np.ndarray, order: np.ndarray, folder: str, limit: int) -> tuple[np.ndarray, int]:
    """The string of names of LMS substrings, which order lists in descending order; and how many names there are."""
    m, n = len(lms), len(s)
    names, last, name = zeros(folder, m, limit), None, 0
    for own in blocks(order, limit):
        q = own if last is None else np.append(last, own)
        i = np.searchsorted(lms, q)
        size = np.where(i + 1 < m, lms[np.minimum(i + 1, m - 1)].astype(np.int64) - q + 1, 1)
        same = size[1:] == size[:-1]
        on, k = np.flatnonzero(same), 0
        while len(on):
            differ = s[np.minimum(q[on] + k, n - 1)] != s[np.minimum(q[on + 1] + k, n - 1)]
            same[on[differ]] = False
            k += 1
            on = on[~differ]
            on = on[size[on] > k]
        number = name + np.append(0, np.cumsum(~same))
        names[i] = number
        last, name = q[-1], int(number[-1])
    for a in range(0, m, limit):
        names[a: a + limit] = name - names[a: a + limit]
    return names, name + 1


def doubled(s: np.ndarray) -> np.ndarray:
    """All suffixes in ascending order, in memory."""
    _, rank = np.unique(s, return_inverse=True)
    n, h = len(s), 1
    while True:
        following = np.append(rank[h:] + 1, np.zeros(min(h, n), np.int64)) if h < n else np.zeros(n, np.int64)
        order = np.lexsort((following, rank))
        fresh = np.append(0, (rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        h *= 2


def suffix_order(s: np.ndarray, folder: str, limit: int) -> np.ndarray:
    """All suffixes in ascending order; the last symbol is the one smallest."""
    if len(s) <= limit:
        return doubled(np.asarray(s))
    down = induce(s, lms_order(s, lms_of(s, folder, limit), folder, limit), folder, limit, True)
    return down[::-1]


def lms_order(s: np.ndarray, lms: np.ndarray, folder: str, limit: int) -> np.ndarray:
    """LMS suffixes in ascending order, by recursion on the names of their LMS substrings."""
    if not len(lms):
        return lms
    down = induce(s, lms, folder, limit, False)
    names, different = _named(s, lms, down, folder, limit)
    if different == len(lms):
        return down[::-1]
    order = suffix_order(names, folder, limit)
    out = Column(folder)
    for own in blocks(order, limit):
        out.add(lms[own])
    return out.read()
