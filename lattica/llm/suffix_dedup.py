"""Suffix-array dedup: bytes in 100-byte strings that also start earlier, by external induced sorting.

Windows are dealt to shards by their anchor (see ``_repeats``), so equal ones meet.  A shard streams the contexts it gets to
a file, and ``InducedSorter`` orders its suffixes.  Suffixes that start a descent-then-ascent (LMS) are ordered first: by
recursion on the string of their names, with queues on disk (``_external``), down to a string that fits in memory (4 * limit
for the first, limit for names), which is sorted there by doubling.  Then two scans induce the order of all others.  What is induced waits in a queue, in order of
symbol and turn, together with its common prefix with the entry before it: 1 more than the least common prefix met since then
in the scan.  Each symbol's queue keeps ``limit`` entries in memory and the rest in files; the text, the LMS suffixes, the order and the
marks of repeated windows are files too, so a shard may be far larger than memory.  Prefixes count up to the width, as longer
ones change nothing; those of neighbouring LMS suffixes are compared directly.

Runs of anchors in very many contexts, short lines that stand in many texts above all, are dealt once more by anchors of 7/8 of
the width, so that few windows that stand once are sent, however often such lines stand in the corpus.

Contexts that repeat an earlier one whole are mostly collapsed before they are dealt (see ``_repeats``), and so are whole texts:
of equal ones (SHA-256) the smallest id's alone is cut into runs, as all of the others stands earlier.  Shards are as many as
keep their texts near ``SHARD`` bytes, whatever the corpus, since the queues on disk take many times the text.

Disk: the runs' shuffle goes before contexts are dealt, the contexts' before documents are put together, and only
documents that lose a part are shuffled for that; others are told where they are read.

Nulls: a null text is empty; rows with a null id are kept whole and lend nothing.  Rows that share an id are documents of
their own, in the order in which they are read: of equal rows the first keeps its text.  An empty table gives no rows.  A
very long text is one task's work when it is cut and put together, but its windows are dealt like others.  Other columns of
docs are not looked at, whatever their names.
"""
from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_bitmap, in_bitmap, shuffle_parts, stage
from ._external import Column, blocks, lms_of, lms_order, zeros
from ._repeats import HOT, byte_symbols, chunks, contexts, covered, finer, joined, judge, lists, numbered, runs, with_factors

FOUND = "doc_id long, rep long, start int, n int"
LEFT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Bytes of contexts a shard gets or so: some third of them are LMS suffixes, which are then sorted in memory.
SHARD = 8 << 20


class Store:
    """One symbol's part of the priority queue: (position, common prefix) in order of turn, as they come; over ``limit`` entries
    go to a file, in order."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.parts: deque = deque()  # arrays or file names
        self.tail: list = []
        self.n = 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.tail.append((pos, lcp))
        self.n += len(pos)
        if self.n >= self.limit:
            name = tempfile.mktemp(dir=self.folder)
            p, q = self._joined()
            with open(name, "wb") as f:
                f.write(p.astype(np.int64).tobytes() + q.astype(np.int16).tobytes())
            self.parts.append(name)

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate(x) for x in zip(*self.tail))
        self.tail, self.n = [], 0
        return p, q

    def _read(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.fromfile(name, np.uint8)
        os.unlink(name)
        n = len(raw) // 10
        return raw[: 8 * n].view(np.int64), raw[8 * n:].view(np.int16)

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest chunk."""
        return self._read(self.parts.popleft()) if self.parts else self._joined() if self.tail else None

    def pop_last(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The youngest chunk."""
        return self._joined() if self.tail else self._read(self.parts.pop()) if self.parts else None


class InducedSorter:
    """Suffixes of t (symbols 0 .. 254, the last of them 0, no 0 beside another) in order of their first ``width`` symbols.  With
    ``padded``, t is the part of it before eight zeros."""

    def __init__(self, t: np.ndarray, width: int, folder: str, limit: int = 1 << 20, padded: np.ndarray | None = None):
        self.t, self.width, self.folder, self.limit = t, width, folder, limit
        self.padded = np.concatenate([t, np.zeros(8, np.uint8)]) if padded is None else padded
        self.lms = lms_of(t, folder, limit)

    def _run(self, i: int) -> int:
        own = np.asarray(self.t[i: i + self.width])
        return int(np.append(np.flatnonzero(own != own[0]), len(own))[0])

    def _seam(self, a: int, b: int) -> int:
        """Common prefix of an L and an S suffix with the same first symbol."""
        return min(self._run(a), self._run(b), self.width)

    def _eight(self, at: np.ndarray) -> np.ndarray:
        return np.ndarray((len(self.t) + 1,), ">u8", self.padded, strides=(1,))[np.minimum(at, len(self.t))].astype(np.uint64)

    def _lms_sorted(self) -> np.ndarray:
        if len(self.lms) > 4 * self.limit:
            return lms_order(self.t, self.lms, self.folder, self.limit)
        lms = np.asarray(self.lms).astype(np.int64)
        m = len(lms)
        size = np.append(lms[1:], len(self.t) - 1) - lms + 1
        rank = np.zeros(m, np.int64)  # where the group of equal ones starts
        active = np.arange(m)
        k = 0
        while len(active):  # names of LMS substrings, eight symbols at a time; a proper prefix is larger
            left = np.clip(size[active] - 8 * k, 0, 8).astype(np.uint64)
            ones = np.uint64(0xFFFFFFFFFFFFFFFF)
            fill = np.where(left >= 8, np.uint64(0), ones >> (np.minimum(left, 7) * np.uint64(8)))
            key = self._eight(lms[active] + 8 * k) | np.where(lms[active] == len(self.t) - 1, np.uint64(0), fill)  # the end is smallest
            self._split(rank, active, key)
            longer = active[size[active] > 8 * (k + 1)]
            active = np.flatnonzero(np.isin(rank, rank[longer])) if len(longer) else longer
            k += 1
        h = 1
        while h <= self.width:  # the string of names, doubled
            count = np.bincount(rank, minlength=m) if m else rank
            active = np.flatnonzero(count[rank] > 1)
            if not len(active):
                break
            following = active + h
            key = np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0).astype(np.uint64)
            self._split(rank, active, key)
            h *= 2
        return lms[np.argsort(rank, kind="stable")]

    @staticmethod
    def _split(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((key, rank[active]))
        r, k = rank[active][order], key[order]
        place = np.arange(len(order))
        head = np.concatenate([[True], r[1:] != r[:-1]])
        start = np.maximum.accumulate(np.where(head, place, 0))
        fresh = head | np.concatenate([[True], k[1:] != k[:-1]])
        rank[active[order]] = r + np.maximum.accumulate(np.where(fresh, place, 0)) - start

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to the width."""
        out = np.zeros(len(a), np.int16)
        live = np.arange(len(a))
        for k in range(0, self.width, 8):
            x = self._eight(a[live] + k) ^ self._eight(b[live] + k)
            lead = np.zeros(len(x), np.int16)
            for shift in (56, 48, 40, 32, 24, 16, 8, 0):
                lead += (x >> np.uint64(shift)) == 0
            out[live] += lead
            live = live[lead == 8]
        return np.minimum(out, self.width)

    def _induce(self, queues: list[Store], carry: np.ndarray, pos: np.ndarray, lcp: np.ndarray, fits: Callable) -> None:
        """Queue what stands before each suffix of the scan, where its symbol fits."""
        before = self.t[np.maximum(pos - 1, 0)]
        j = np.flatnonzero((pos > 0) & fits(before))
        least = lcp.min()
        if not len(j):
            np.minimum(carry, least, out=carry)
            return
        s = before[j]
        order = np.argsort(s, kind="stable")
        j, s = j[order], s[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        m, g = len(j), len(head)
        # for each symbol the places 0, j1 + 1, j2 + 1, ...: the minima between them are what the pushes share
        group = np.repeat(np.arange(g), np.diff(np.append(head, m)))
        at = np.zeros(m + g, np.int64)
        at[np.arange(m) + group + 1] = j + 1
        least_of = np.minimum.reduceat(np.append(lcp, np.int16(32767)), at)[np.arange(m) + group]
        symbols = s[head]
        least_of[head] = np.minimum(least_of[head], carry[symbols])
        new = np.minimum(least_of + 1, self.width).astype(np.int16)
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(32767))
        np.minimum(carry, least, out=carry)
        last = np.append(head[1:], m) - 1
        carry[symbols] = after[j[last] + 1]
        p = pos[j] - 1
        for x, a, b in zip(symbols.tolist(), head.tolist(), (last + 1).tolist()):
            queues[x].push(p[a:b], new[a:b])

    def _seeds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(symbol, positions, common prefixes) of LMS suffixes, from the smallest on."""
        last = None
        for own in blocks(self._lms_sorted(), self.limit):
            own = own.astype(np.int64)
            common = np.zeros(len(own), np.int16)
            common[1:] = self._common(own[:-1], own[1:])
            if last is not None:
                common[:1] = self._common(last, own[:1])
            last = own[-1:]
            lead = self.t[own]
            cut = np.flatnonzero(np.append(True, lead[1:] != lead[:-1])).tolist()
            for a, b in zip(cut, [*cut[1:], len(own)]):
                yield int(lead[a]), own[a:b], common[a:b]

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the largest on: chunks of positions and common prefixes with the one before."""
        t, sigma = self.t, 256
        make = lambda: [Store(self.folder, self.limit) for _ in range(sigma)]
        queues, done, carry = make(), make(), np.full(sigma, -1, np.int16)
        seeds = self._seeds()
        seed = next(seeds, None)
        for c in range(sigma):  # L suffixes from the smallest on
            end = None
            while (got := queues[c].pop()) is not None:
                self._induce(queues, carry, *got, lambda b, c=c: b >= c)
                done[c].push(*got)
                end = got[0][-1]
            first = True
            while seed and seed[0] == c:
                _, own, common = seed
                if first:
                    common[0], first = 0 if end is None else self._seam(end, own[0]), False
                self._induce(queues, carry, own, common, lambda b, c=c: b > c)
                seed = next(seeds, None)
        queues, carry = make(), np.full(sigma, -1, np.int16)
        for c in range(sigma - 1, -1, -1):  # S suffixes from the largest on
            end = None
            while (got := queues[c].pop()) is not None:
                self._induce(queues, carry, *got, lambda b, c=c: b <= c)
                end = got[0][-1]
                yield got
            link = 0
            while (got := done[c].pop_last()) is not None:
                pos, lcp = got[0][::-1], got[1][::-1]
                down = np.append(np.int16(link if end is None or link else self._seam(pos[0], end)), lcp[:-1])
                link, end = lcp[-1], end if end is None else end
                self._induce(queues, carry, pos, down, lambda b, c=c: b < c)
                yield pos, down


class Repeats:
    """Marks the positions of t whose window of ``width`` symbols stands earlier in t, from chunks of the descending order."""

    def __init__(self, marks: np.ndarray, width: int):
        self.marks, self.width = marks, width
        self.low: int | None = None  # the earliest position of the last group

    def add(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        alike = lcp >= self.width
        go_on = bool(alike[0]) and self.low is not None
        head = np.flatnonzero(~alike)
        if not len(head) or head[0]:
            head = np.append(0, head)
        size = np.diff(np.append(head, len(pos)))
        low = np.minimum.reduceat(pos, head)
        member = np.repeat(size > 1, size)
        if go_on:
            member[: size[0]] = True
            self.marks[self.low] = 1
            low[0] = min(low[0], self.low)
        self.marks[pos[member]] = 1
        self.marks[low] = 0
        self.low = int(low[-1])


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> tuple[Column, Column]:
    """The text of a shard, contexts apart by 0xff, and its rows (doc_id, rep, start, n, place in the text)."""
    text, rows = Column(folder, np.uint8), Column(folder)
    for b in batches:
        own = b.column(5).to_pylist()
        size = np.array([len(x) for x in own], np.int64)
        at = text.n + np.cumsum(size + 1) - size - 1
        text.add(np.frombuffer(b"\xff".join([*own, b""]), np.uint8))
        rows.add(np.stack([*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4)), at], 1).ravel())
    return text, rows


def repeated_windows(text: Column, rows: Column, width: int, folder: str, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, rep, start, n) of runs of windows that an earlier one equals; rows are in order of place, and the first n windows
    of each count."""
    n = text.n
    text.add(np.zeros(8, np.uint8))
    text.read()
    padded = np.memmap(text.path, np.uint8, "r+")
    for a in range(0, n, 1 << 24):
        padded[a: min(n, a + (1 << 24))] += np.uint8(1)  # 0xff, which no UTF-8 text holds, becomes 0
    marks = zeros(folder, n, 16 * limit, np.uint8)
    found = Repeats(marks, width)
    for pos, lcp in InducedSorter(padded[:n], width, folder, limit, padded).descending():
        found.add(pos, lcp)
    for own in blocks(rows.read(), 5 * (1 << 16)):
        d, p, s, m, at = own.reshape(-1, 5).T
        row = np.repeat(np.arange(len(m)), m)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        hit = np.flatnonzero(marks[at[row] + inside])
        row, inside = row[hit], inside[hit]
        if len(hit):
            yield joined(d[row], p[row], s[row] + inside, np.ones(len(hit), np.int32), np.zeros(len(hit), np.int64), s[row] + inside)[:4]


def _spans(buf: np.ndarray, offs: np.ndarray):
    return lambda i: i, lambda i: i + 1, offs


def _shard(width: int, limit: int):
    def out(d, p, s, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": d.astype(np.int64), "rep": p.astype(np.int64), "start": s.astype(np.int32), "n": n.astype(np.int32)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: deque = deque()

        def fresh() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(8).to_numpy(zero_copy_only=False)
                if known.any():
                    told.append(out(*(batch.column(i).to_numpy(zero_copy_only=False)[known] for i in (1, 2, 3, 4))))
                    batch = batch.filter(pa.array(~known))
                if batch.num_rows:
                    yield batch

        with tempfile.TemporaryDirectory() as folder:
            text, rows = _written(fresh(), folder)
            while told:
                yield told.popleft()
            if rows.n:
                for found in repeated_windows(text, rows, width, folder, limit):
                    yield out(*found)

    return each


def first_ids(docs: DataFrame) -> np.ndarray:
    """A bitmap of the smallest ids of equal texts.  A text whose bit is 0 surely stands whole under a smaller id."""
    own = docs.where(F.col("doc_id").isNotNull()).groupBy(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text"))
    return id_bitmap(own.agg(F.min("doc_id").alias("doc_id")))


def shards(first: DataFrame, width: int, least: int, size: int = SHARD) -> int:
    """How many keep what each is sent near ``size`` bytes; contexts of hot anchors are sent a window each."""
    own = first.where("kind = 2").groupBy("anchor").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    total = own.agg(F.sum(F.when(F.col("c") > HOT, F.col("n") * width).otherwise(F.col("n") + F.col("c") * (width - 1))).alias("b")).first().b or 0
    return max(least, -(-int(total) // size))


def factors(docs: DataFrame, width: int = 100, k: int = 32, collapse: bool = True, limit: int = 1 << 20, only=None) -> DataFrame:
    """doc_id, rep, start, n: windows (bytes) that stand earlier, by smaller doc_id or earlier place; docs from ``numbered``."""
    n = shuffle_parts(docs.sparkSession)
    first = stage(judge(runs(docs, byte_symbols, width, k, collapse, only), n).select("doc_id", "rep", "start", "n", "anchor", "kind"), release=True)
    first = finer(docs, first, byte_symbols, width, max(k, width - width // 8), n, collapse)
    sent = contexts(docs, first, byte_symbols, _spans, width, collapse).repartition(shards(first, width, n), "key").sortWithinPartitions("doc_id", "rep", "start")
    found = stage(sent.mapInArrow(_shard(width, limit), FOUND), release=True)
    return first.where("kind = 1").select("doc_id", "rep", "start", "n").unionByName(found)


def _left(ids: pa.Array, sizes: np.ndarray, gone: np.ndarray, spans: list, kept) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def suffix_dedup(docs: DataFrame, width: int = 100, k: int = 32, collapse: bool = True, limit: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs: start, end) and kept (the bytes left)."""
    docs, share = numbered(docs), docs.sparkSession.sparkContext.broadcast
    first = share(first_ids(docs)) if collapse else None
    found = factors(docs, width, k, collapse, limit, first)
    touched = share(id_bitmap(found.select("doc_id").distinct()))

    def known(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which texts stand whole under a smaller id, and which of the others may have factors."""
        some = np.asarray(ids.is_valid())
        own = ids.fill_null(0).to_numpy(zero_copy_only=False)
        copy = some & ~in_bitmap(own, first.value) if first is not None else np.zeros(len(own), bool)
        return copy, some & ~copy & in_bitmap(own, touched.value)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, maybe = known(batch.column(0))
            batch, copy = batch.filter(pa.array(~maybe)), copy[~maybe]
            at = 0
            for _, buf, offs, part in chunks(batch):
                size = np.diff(offs)
                gone = copy[at: at + len(size)] & (size >= width)
                at += len(size)
                raw = buf.tobytes()
                kept = [b"" if g else raw[a:b] for g, a, b in zip(gone.tolist(), offs[:-1].tolist(), offs[1:].tolist())]
                yield _left(part.column(0), size, np.where(gone, size, 0), [[{"start": 0, "end": n}] if g else [] for g, n in zip(gone.tolist(), size.tolist())], kept)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known(batch.column(0))[1]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs, part in chunks(batch):
                s, at = lists(part.column(2))
                n, _ = lists(part.column(3))
                rows = []
                for i in range(len(offs) - 1):
                    own, text = slice(at[i], at[i + 1]), buf[offs[i]: offs[i + 1]]
                    if at[i] == at[i + 1]:
                        rows.append((0, text.tobytes(), []))
                        continue
                    gone = covered(len(text), s[own], n[own], width)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    rows.append((int(gone.sum()), text[~gone].tobytes(), [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]))
                yield _left(part.column(0), np.diff(offs), [r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows])

    found = found.withColumns({"ref_doc": F.lit(0).cast("long"), "ref_start": F.lit(0)})
    apart = with_factors(docs.mapInArrow(parted, "doc_id long, rep long, text string"), found).mapInArrow(remove, LEFT)
    return docs.mapInArrow(at_once, LEFT).unionByName(apart)
