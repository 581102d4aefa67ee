"""Best-fit packing by linear grouping.

Lengths are small integers, so the plan is made from their histogram (at most ``capacity`` rows), never from documents.
Large lengths, sorted, are cut into groups of equal cardinality and rounded up to their group's largest.  For these few
sizes configurations of a sequence are chosen, fullest first (a bounded knapsack over what is left), each used as often
as it can be.  Then actual lengths take the slots of their group, which leaves room by what was rounded, and small
lengths fill the room, largest first, each into the sequence with the least room that still takes it.  Sequences of
equal content are kept as runs, so the plan's size depends on lengths and configurations only.

Documents get their place by their rank among those of equal length.  Ranks are counted in two levels (salted by id, the
more the hotter a length is), so a hot length is no one task's work; the sizes of the salts, no more in number than
lengths and tasks, are added up on the driver.

Nulls: a null or empty text has the end token only; a null doc_id is an id like others.  Every row is packed, repeated
ones too (equal rows are told apart by nothing but their place).  An empty table gives no rows.  Very long texts are encoded
whole, by one task each.  Other columns of docs are not looked at.
"""
from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_parts, stage
from ._repeats import chunks
from ._vec import word_hashes

CAPACITY = 2048


_ODD = np.zeros(256, bool)  # bytes that white space can begin with
_ODD[[9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WHITE = re.compile(r"[^\S\x1c-\x1f]")


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers.

    The byte-level BPE of ``ranks`` is run by tiktoken, which gives the ids that tokenizers gives for the same vocabulary
    some five times as fast.  Texts are cut before each space: the pattern cuts there too wherever no white space follows,
    so the ids of a text are those of its words with their space, each encoded once and kept by its hash (a bounded
    number, for the life of the worker).  Texts where white space follows a space, or that hold the string of a special
    token (which is one token, wherever it stands), are encoded whole."""

    def __init__(self, ranks: str, pattern: str, special: dict[str, int] | None = None, limit: int = 1_000_000):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special or {})
        self.special = [x.encode() for x in special or {}]
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            self.size[i] = len(piece)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    @classmethod
    def of_worker(cls, ranks: str, pattern: str, special: dict[str, int] | None = None) -> Encoder:
        import tiktoken

        kept, key = tiktoken.__dict__.setdefault("_encoders_of_worker", {}), (ranks, pattern, *sorted((special or {}).items()))
        if key not in kept:
            kept[key] = cls(ranks, pattern, special)
        return kept[key]

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=()), "<u4") if text else np.empty(0, "<u4")

    def _learn(self, buf: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Words of the buffer, their space first, by ascending key."""
        size = end - start
        total = np.cumsum(size)
        text = buf[np.repeat(start - (total - size), size) + np.arange(int(total[-1]))].tobytes().decode()
        ids = self.ids(text)
        stop = np.searchsorted(np.cumsum(self.size[ids]), total, side="left") + 1
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(ids), self.used), "<u4")])
        self.pool[self.used: self.used + len(ids)] = ids
        first = np.append(0, stop[:-1])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, self.used + first), np.insert(self.n, place, stop - first)
        self.used += len(ids)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The ids of each text."""
        lead = offs[:-1][np.diff(offs) > 0]
        mark = buf == 32
        mark[lead] = True
        start = np.flatnonzero(mark)
        end = np.append(start[1:], len(buf))
        head = np.zeros(len(buf), bool)
        head[lead] = True
        follows = np.append(buf, np.uint8(32))[np.minimum(start + 1, len(buf))]
        odd = (buf[start] == 32) & (_ODD[follows] | (end - start == 1)) if len(start) else np.zeros(0, bool)
        whole = set()
        for i in np.unique(np.searchsorted(offs, start[odd], side="right") - 1).tolist():
            text = buf[offs[i]: offs[i + 1]].tobytes().decode()
            if any(_WHITE.match(text, k + 1) or k + 1 == len(text) for k in _spaces(text)):
                whole.add(i)
        raw = buf.tobytes() if self.special else b""
        for mark in self.special:
            k = raw.find(mark)
            while k >= 0:  # the last text that starts no later; strings across two texts send one of them the slow way, no more
                whole.add(int(np.searchsorted(offs, k, side="right")) - 1)
                k = raw.find(mark, k + 1)
        usual = ~head[start] & ~np.isin(np.searchsorted(offs, start, side="right") - 1, list(whole)) if whole else ~head[start]
        s, e = start[usual], end[usual]
        keys = word_hashes(buf, s, e)
        u, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            if len(self.keys) + len(new) > self.limit:
                self._forget()
                new = np.arange(len(u))
            self._learn(buf, u[new], s[first[new]], e[first[new]])
        at = np.searchsorted(self.keys, u)[inverse]
        n, place = self.n[at], self.at[at]
        total = np.cumsum(n)
        flat = self.pool[np.repeat(place - (total - n), n) + np.arange(int(total[-1]) if len(n) else 0)]
        of = np.append(0, total)[np.searchsorted(s, offs)]
        out = []
        heads = dict(zip(lead.tolist(), end[head[start]].tolist()))
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            if i in whole or a == b:
                out.append(self.ids(buf[a:b].tobytes().decode()).tobytes())
            else:
                out.append(self.ids(buf[a: heads[a]].tobytes().decode()).tobytes() + flat[of[i]: of[i + 1]].tobytes())
        return out


def _spaces(text: str) -> Iterator[int]:
    k = text.find(" ")
    while k >= 0:
        yield k
        k = text.find(" ", k + 1)


def pieces(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: texts with an end token, cut where longer than a sequence; the first piece is the shorter."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(ranks, pattern, special)
        for batch in batches:
            out: list[tuple] = []
            for _, buf, offs, part in chunks(batch):
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(buf, offs)):
                    raw += b"\0\0\0\0"
                    n = len(raw) // 4
                    at, end = 0, n % capacity or capacity
                    k = 0
                    while at < n:
                        out.append((doc, k, at, end - at, zlib.crc32(raw[4 * at: 4 * end])))
                        at, end, k = end, end + capacity, k + 1
            if out:
                d, k, s, n, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long")


def groups_of(histogram: dict[int, int], n: int) -> list[list[int]]:
    """Lengths in ascending groups of about equal cardinality."""
    total, out, run, seen = sum(histogram.values()), [], [], 0
    for x in sorted(histogram):
        run.append(x)
        seen += histogram[x]
        if seen * n >= total * (len(out) + 1):
            out.append(run)
            run = []
    return out + [run] if run else out


def configurations(sizes: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: slots}): the best company of the largest size left, as often as it can be, until nothing is left."""
    left, out = dict(sizes), []
    while left:
        top = max(left)
        used: dict[int, dict[int, int]] = {top: {top: 1}}  # by fill
        for s in sorted(left, reverse=True):  # larger sizes first: of equal fills the one of fewer documents stays
            for fill in sorted(used):
                config = used[fill]
                for k in range(1, min(left[s] - config.get(s, 0), (capacity - fill) // s) + 1):
                    used.setdefault(fill + k * s, config | {s: config.get(s, 0) + k})
            if capacity in used:
                break
        config = used[max(used)]
        times = min(left[s] // k for s, k in config.items())
        out.append((times, config))
        left = {s: n - times * config.get(s, 0) for s, n in left.items() if n > times * config.get(s, 0)}
    return out


class Plan:
    """Runs of equal sequences: [times, room, [(length, count), ...]]."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, n_groups: int = 200, small: int = 600):
        self.capacity = capacity
        large = {x: n for x, n in histogram.items() if x > small}
        few = {x: n for x, n in histogram.items() if x <= small}
        groups = groups_of(large, n_groups)
        of = {g[-1]: [[x, large[x]] for x in g] for g in groups}  # rounded size -> actual lengths left
        self.runs: list[list] = []
        for times, config in configurations({s: sum(n for _, n in own) for s, own in of.items()}, capacity):
            self._substitute(times, config, of)
        self._fill(few)

    def _substitute(self, times: int, config: dict[int, int], of: dict[int, list[list[int]]]) -> None:
        while times:  # as many sequences at a time as get the same actual lengths
            now, step = [], times
            for size, slots in config.items():
                need = slots
                for x, n in reversed(of[size]):
                    k = min(need, n)
                    if k:
                        now.append((size, x, k))
                        step = min(step, n // k)
                        need -= k
                    if not need:
                        break
            for size, x, k in now:
                for own in of[size]:
                    if own[0] == x:
                        own[1] -= k * step
                of[size] = [own for own in of[size] if own[1]]
            self.runs.append([step, self.capacity - sum(x * k for _, x, k in now), [(x, k) for _, x, k in now]])
            times -= step

    def _fill(self, few: dict[int, int]) -> None:
        by_room: dict[int, list[list]] = {}
        for run in self.runs:
            by_room.setdefault(run[1], []).append(run)
        for x in sorted(few, reverse=True):
            n = few[x]
            while n:
                room = min((r for r in by_room if r >= x), default=None)
                if room is None:
                    k = min(self.capacity // x, n)
                    made = [[n // k, self.capacity - k * x, [(x, k)]]]
                    n -= n // k * k
                else:
                    run = by_room[room].pop()
                    if not by_room[room]:
                        del by_room[room]
                    k = min(room // x, n)
                    times = min(run[0], n // k)
                    made = [[times, room - k * x, run[2] + [(x, k)]]]
                    if run[0] > times:
                        made.append([run[0] - times, room, run[2]])
                    n -= times * k
                for m in made:
                    by_room.setdefault(m[1], []).append(m)
        self.runs = [run for own in by_room.values() for run in own]

    def sequences(self) -> int:
        return sum(run[0] for run in self.runs)

    def slots(self) -> dict[int, tuple[np.ndarray, ...]]:
        """length -> (first rank, first sequence, count a sequence, offset), in order of rank."""
        out: dict[int, list] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for times, _, content in self.runs:
            offset = 0
            for x, k in content:
                out.setdefault(x, []).append((ranks.get(x, 0), sequence, k, offset))
                ranks[x] = ranks.get(x, 0) + times * k
                offset += x * k
            sequence += times
        return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def _salted(cut: DataFrame, histogram: dict[int, int], groups: int) -> DataFrame:
    """Adds salt: rows of one length are dealt to as many salts as their share of ``groups``, one at least.  In all there are
    no more pairs of length and salt than lengths and groups."""
    total = max(1, sum(histogram.values()))
    salts = cut.sparkSession.createDataFrame([(x, -(-n * groups // total)) for x, n in histogram.items()], "length long, salts int")
    return cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts").cast("int")).drop("salts")


def _before(salted: DataFrame) -> dict[int, np.ndarray]:
    """length -> rows of smaller salts, by salt."""
    counts: dict[int, dict[int, int]] = {}
    for r in salted.groupBy("length", "salt").count().collect():
        counts.setdefault(r.length, {})[r.salt] = r["count"]
    return {x: np.cumsum([0] + [own.get(i, 0) for i in range(max(own))]) for x, own in counts.items()}


def pack(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int] | None = None, capacity: int = CAPACITY, n_groups: int = 200, small: int = 600) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = stage(pieces(docs, ranks, pattern, special, capacity))
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    salted = _salted(cut, histogram, 4 * shuffle_parts(docs.sparkSession))
    context = docs.sparkSession.sparkContext
    slots = context.broadcast(Plan(histogram, capacity, n_groups, small).slots())
    before = context.broadcast(_before(salted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, salt, r = (batch.column(i).to_numpy() for i in (3, 5, 6))
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for own in np.unique(x):
                at = np.flatnonzero(x == own)
                rank, first, k, off = slots.value[int(own)]
                own_rank = before.value[int(own)][salt[at]] + r[at]
                i = np.searchsorted(rank, own_rank, side="right") - 1
                since = own_rank - rank[i]
                sequence[at] = first[i] + since // k[i]
                offset[at] = off[i] + since % k[i] * own
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", rank.cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
