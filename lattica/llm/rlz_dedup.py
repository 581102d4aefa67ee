"""Substring dedup by relative Lempel-Ziv parsing: words in 20-word windows that stand earlier elsewhere.

The corpus is its own reference, indexed in blocks.  All occurrences of a window meet in one block, that of its anchor (see
``_repeats``), and each document is sent, stretch by stretch, to every block that can hold any of its windows.  A block
indexes the words of its stretches by the hash of every ``width`` words.  A stretch is factored greedily: at each place the
index names the earliest place that may agree; the words of both are compared and the factor goes on as long as they agree
and the reference lasts.  After a factor the parse goes on at the first window that the factor doesn't hold, which crosses
its boundary: so each boundary is checked.  Factors of ``width`` words or more are duplicate spans.  Back in the document
the factors of all blocks are parsed once more, from left to right, each the one that reaches farthest.

Stretches that repeat an earlier one whole are mostly collapsed before they are sent (see ``_repeats``).  Words count as
equal if their 64-bit hashes are.

Nulls: a null text has no words; rows with a null id are kept as they are and lend nothing.  Rows that share an id are
documents of their own, in the order in which they are read: of equal rows the first keeps its text.  An empty table gives
no rows.  A very long text is one task's work when it is cut and put together, but its windows are dealt like others.  Other
columns of docs are not looked at, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import shuffle_parts, stage
from ._repeats import CHUNK, HOT, chunks, contexts, covered, joined, judge, lists, numbered, runs, with_factors, word_symbols
from ._vec import U, Ranges, mix, pack, word_hashes, word_spans

FOUND = "doc_id long, rep long, start int, n int, ref_doc long, ref_start int"


def _spans(buf: np.ndarray, offs: np.ndarray):
    starts, ends, before = word_spans(buf, offs)
    return lambda i: starts[i], lambda i: ends[i], before


def parse_block(key: np.ndarray, n: np.ndarray, texts: pa.Array, width: int, fresh: int = 0) -> tuple[np.ndarray, ...]:
    """Greedy factors of stretches, in order, against those before them of the same key: (row, window, windows, row and window
    referred to).  Stretch i has n[i] windows.  Stretches before ``fresh`` are reference only."""
    buf, offs = pack(texts)
    starts, ends, before = word_spans(buf, offs)
    word = word_hashes(buf, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = before[row] + inside
    gram = Ranges(word).hash(at, at + width) ^ mix(key.view(U))[row]
    _, first, same = np.unique(gram, return_index=True, return_inverse=True)
    ref = first[same]  # the index: the earliest window of this hash
    known = np.flatnonzero((ref < np.arange(len(ref))) & (row >= fresh))
    out: list[tuple] = []
    now = known[np.unique(row[known], return_index=True)[1]]  # a place in each stretch
    while len(now):
        a, b = at[now], at[ref[now]]
        most = np.minimum(before[row[now] + 1] - a, before[row[ref[now]] + 1] - b)
        size, on = np.zeros(len(now), np.int64), np.arange(len(now))
        while len(on):  # the factor goes on while the words agree
            on = on[size[on] < most[on]]
            on = on[word[a[on] + size[on]] == word[b[on] + size[on]]]
            size[on] += 1
        good = size >= width
        out.append((row[now[good]], inside[now[good]], size[good] - width + 1, row[ref[now[good]]], inside[ref[now[good]]]))
        following = now + np.where(good, size - width + 1, 1)
        j = np.searchsorted(known, following)
        there = j < len(known)
        there[there] = row[known[j[there]]] == row[now[there]]
        now = known[j[there]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 5


def _blocks(width: int):
    def out(d, p, s, n, rd, rs) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": d.astype(np.int64), "rep": p.astype(np.int64), "start": s.astype(np.int32), "n": n.astype(np.int32), "ref_doc": rd.astype(np.int64), "ref_start": rs.astype(np.int32)})

    def told(t: pa.Table, fresh: int) -> pa.RecordBatch:
        key, d, p, s, n = (t.column(i).to_numpy() for i in range(5))
        row, w, size, ref, rw = parse_block(key, n, t.column(5).combine_chunks(), width, fresh)
        return out(*joined(d[row], p[row], s[row] + w, size, d[ref], s[ref] + rw))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key and place.  Holds the stretches of some keys, of one at least; of a hot window's rows the first alone."""
        held, size, fresh = [], 0, 0
        for batch in batches:
            known = batch.column(8).to_numpy(zero_copy_only=False)
            if known.any():
                yield out(*(batch.column(i).to_numpy(zero_copy_only=False)[known] for i in (1, 2, 3, 4, 6, 7)))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < 4 * CHUNK:
                continue
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # keys before the last are whole
            if cut > 0:
                yield told(t.slice(0, cut), fresh)
                t, fresh = t.slice(cut), 0
            if t.num_rows > 2 * HOT:
                yield told(t, fresh)
                t, fresh = t.slice(0, 1), 1
            held = t.combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield told(pa.Table.from_batches(held), fresh)

    return each


def factors(docs: DataFrame, width: int = 20, k: int = 6, collapse: bool = True) -> DataFrame:
    """doc_id, rep, start, n, ref_doc, ref_start: windows that stand earlier, by smaller doc_id or earlier place; docs from
    ``numbered``."""
    n = shuffle_parts(docs.sparkSession)
    first = stage(judge(runs(docs, word_symbols, width, k, collapse), n))
    sent = contexts(docs, first, word_symbols, _spans, width, collapse).repartition(n, "key").sortWithinPartitions("key", "doc_id", "rep", "start")
    return first.where("kind = 1").select("doc_id", "rep", "start", "n", "ref_doc", "ref_start").unionByName(sent.mapInArrow(_blocks(width), FOUND))


def parse(starts: np.ndarray, ns: np.ndarray, ref_docs: np.ndarray, ref_starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors of one document, (start, n, ref_doc, ref_start) in windows, from its matches in order of start: from each
    place the match that reaches farthest."""
    zero = np.zeros(len(starts), np.int64)
    _, _, *m = joined(zero, zero, starts, ns, ref_docs, ref_starts)
    out, at, best, todo = [], 0, None, list(zip(*(x.tolist() for x in m)))
    k = 0
    while k < len(todo) or best:
        while k < len(todo) and todo[k][0] <= at:
            if best is None or sum(todo[k][:2]) > sum(best[:2]):
                best = todo[k]
            k += 1
        if best is None or sum(best[:2]) <= at:
            if k == len(todo):
                break
            best, at = None, todo[k][0]
            continue
        out.append((at, sum(best[:2]) - at, best[2], best[3] + at - best[0]))
        at, best = sum(best[:2]), None
    return out


def rlz_dedup(docs: DataFrame, width: int = 20, k: int = 6, collapse: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and factors (start, words, ref_doc, ref_start)."""
    docs = numbered(docs)
    found = with_factors(docs, factors(docs, width, k, collapse))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, offs, part in chunks(batch):
                w_start, w_end, before = word_spans(buf, offs)
                s, at = lists(part.column(2))
                n, rd, rs = (lists(part.column(i))[0] for i in (3, 4, 5))
                raw = buf.tobytes()
                rows = []
                for i in range(len(offs) - 1):
                    a, b = before[i], before[i + 1]
                    own = slice(at[i], at[i + 1])
                    told = parse(s[own], n[own], rd[own], rs[own])
                    keep = ~covered(b - a, np.array([f[0] for f in told], np.int64), np.array([f[1] for f in told], np.int64), width)
                    kept = b" ".join([raw[x:y] for x, y in zip(w_start[a:b][keep].tolist(), w_end[a:b][keep].tolist())])
                    rows.append((int(b - a), int((~keep).sum()), kept, [{"start": p, "words": q - 1 + width, "ref_doc": x, "ref_start": y} for p, q, x, y in told]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))),
                ], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    return found.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>")
