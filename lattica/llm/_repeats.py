"""Routing for exact repeats of W symbols (words or bytes): what the substring operators share.

All windows of W symbols of a text are dealt to their anchors: a window's anchor is its leftmost smallest K-symbol hash,
so equal windows have equal anchors, and successive windows mostly share one.  A run is the windows of one text that
share one anchor; its context is the symbols they span.  ``runs`` gives a small row per run: the anchor's hash, a hash
of the context, and the place.  Runs whose anchor occurs once have no repeat and go.  Of the others the symbols are sent to
a block, by anchor, where the operator compares them.  An anchor of more than HOT contexts is split: its windows are dealt
one by one, by a hash of the window.

Runs are collapsed before they are sent: of equal contexts (64-bit hashes) the first alone goes, the others repeat it
whole.  So no anchor, however frequent, has more rows than there are batches and contexts.  ``collapse=False`` leaves this
out: then every run of a repeated anchor is compared symbol by symbol, and nothing rests on hashes of contexts.

Rows of one doc_id are told apart by ``rep``, 0 where ids don't repeat, else a number in order of reading.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_bitmap, in_bitmap, stage
from ._vec import BASE, BYTE_VALUES, U, Ranges, leftmost_min, mix, pack, word_hashes, word_spans

Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Texts are taken together up to so many bytes.
CHUNK = 2 << 20
#: Contexts of one anchor that one task may hold.
HOT = 1024
RUN = "anchor long, context long, doc_id long, rep long, start int, n int, ref_doc long, ref_start int, known boolean"
#: Windows start .. start + n - 1 of doc_id repeat those from ref_start of ref_doc.
FACTOR = "doc_id long, rep long, start int, n int, ref_doc long, ref_start int, anchor long, kind byte"
#: What a block gets: the symbols of a run, or a known factor.
CONTEXT = "key long, doc_id long, rep long, start int, n int, context binary, ref_doc long, ref_start int, known boolean"


def byte_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[buf], offs


def word_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = word_spans(buf, offs)
    return word_hashes(buf, starts, ends), before


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, rep, text.  Where ids repeat the rows are written once with a number each, so that it stays the same."""
    own = docs.select("doc_id", "text")
    if own.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        return own.select("doc_id", F.lit(0).cast("long").alias("rep"), "text")
    return stage(own.select("doc_id", F.monotonically_increasing_id().alias("rep"), "text"))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """doc_ids, bytes and offsets of parts of a batch of (doc_id, text, ...)."""
    text = batch.column(batch.schema.get_field_index("text"))
    _, offs = pack(text)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, side="right")) - 1)
        part = batch.slice(at, end - at)
        buf, own = pack(part.column(batch.schema.get_field_index("text")))
        ids = part.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
        yield ids, buf, own, part
        at = end


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _runs_of(ids: np.ndarray, reps: np.ndarray, values: np.ndarray, before: np.ndarray, width: int, k: int, collapse: bool, only: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray] | None:
    """Runs of a chunk of texts, places counted within each text.  ``only``: where stretches of windows to look at start and end."""
    if len(values) < width:
        return None
    ranges = Ranges(values)
    grams = ranges.windows(k)
    owner = leftmost_min(grams, width - k + 1)  # of the window that starts at each place
    sizes = np.diff(before)
    lasts = np.flatnonzero(sizes >= width)
    first_place, past = only or (before[lasts], before[lasts + 1] - width + 1)  # windows of each text that has any
    new = np.zeros(len(owner) + 1, bool)
    new[1:-1] = owner[1:] != owner[:-1]
    new[first_place] = True
    new[past] = True
    inside = np.zeros(len(owner) + 1, np.int8)
    inside[first_place] = 1
    np.add.at(inside, past, -1)
    bound = np.flatnonzero(new)
    if not len(lasts):
        return None
    within = np.cumsum(inside)[bound] > 0
    bound = np.append(bound, len(owner))
    first, last = bound[:-1][within], bound[1:][within]  # last: one past the run's last window
    doc = np.searchsorted(before, first, side="right") - 1
    context = ranges.hash(first, last - 1 + width)
    context = mix(context + (owner[first] - first).astype(np.uint64))
    d, p, s = ids[doc].astype(np.int64), reps[doc].astype(np.int64), (first - before[doc]).astype(np.int32)
    if not collapse:  # no two alike
        context = mix(mix(d.view(U) + U(1)) * U(BASE) + mix(p.view(U) + U(2)) + s.astype(U))
    return {"anchor": grams[owner[first]].view(np.int64), "context": context.view(np.int64), "doc_id": d, "rep": p, "start": s, "n": (last - first).astype(np.int32)}


def _first_alike(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of anchor, context and place; which are the first of their anchor and context; and those of the others."""
    order = np.lexsort((r["start"], r["rep"], r["doc_id"], r["context"], r["anchor"]))
    r = {k: x[order] for k, x in r.items()}
    a, c = r["anchor"], r["context"]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return r, first, np.flatnonzero(first)[np.cumsum(first) - 1][~first]


def _dealt(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batch's runs in order of anchor and context; repeats of its own runs become known factors, joined where they follow."""
    r, first, of = _first_alike(r)
    a, c, d, p, s, n = (r[k] for k in ("anchor", "context", "doc_id", "rep", "start", "n"))
    none, no = np.zeros(int(first.sum()), np.int64), np.zeros(int(first.sum()), bool)
    yield pa.RecordBatch.from_pydict({"anchor": a[first], "context": c[first], "doc_id": d[first], "rep": p[first], "start": s[first], "n": n[first], "ref_doc": none, "ref_start": none.astype(np.int32), "known": no})
    if not len(of):
        return
    d, p, s, n, rd, rs = joined(d[~first], p[~first], s[~first], n[~first], d[of], s[of])
    zero = np.zeros(len(d), np.int64)
    yield pa.RecordBatch.from_pydict({"anchor": zero, "context": zero, "doc_id": d, "rep": p, "start": s, "n": n, "ref_doc": rd, "ref_start": rs, "known": zero == 0})


def joined(d, p, s, n, rd, rs) -> tuple[np.ndarray, ...]:
    """Factors in order, those joined that go on in the same text and in the same reference."""
    order = np.lexsort((s, p, d))
    d, p, s, n, rd, rs = (x[order] for x in (d, p, s, n, rd, rs))
    on = (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (s[1:] == s[:-1] + n[:-1]) & (rd[1:] == rd[:-1]) & (rs[1:] - rs[:-1] == s[1:] - s[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~on])[: len(d)])
    return d[head], p[head], s[head], np.add.reduceat(n, head).astype(np.int32) if len(head) else n, rd[head], rs[head]


def runs(docs: DataFrame, symbols: Symbols, width: int, k: int, collapse: bool = True, only=None) -> DataFrame:
    """A row per run that is the first of its anchor and context in its batch, and the others as known factors.  ``only``: a
    broadcast bitmap of the ids to read (see ``id_bitmap``)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(zero_copy_only=False), only.value)))
            parts = [r for ids, buf, offs, part in chunks(batch) if (r := _runs_of(ids, _long(part.column(1)), *symbols(buf, offs), width, k, collapse))]
            if parts:
                yield from _dealt({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "rep", "text").mapInArrow(deal, RUN)


def judge(dealt: DataFrame, n: int) -> DataFrame:
    """Factors of kind 1, which repeat an earlier run whole, and of kind 2: first of their context, with an anchor that has
    other contexts.  Partitions are sorted and streamed: memory is one batch.  Known factors are spread by place."""
    key = F.when(F.col("known"), F.xxhash64("doc_id", "rep", "start")).otherwise(F.col("anchor"))
    own = dealt.repartition(n, key).sortWithinPartitions("known", "anchor", "context", "doc_id", "rep", "start")

    def out(d, p, s, w, rd, rs, a, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": d.astype(np.int64), "rep": p.astype(np.int64), "start": s.astype(np.int32), "n": w.astype(np.int32), "ref_doc": rd.astype(np.int64), "ref_start": rs.astype(np.int32), "anchor": a.astype(np.int64), "kind": np.full(len(d), kind, np.int8)})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first-of-context row, not told yet, and whether its anchor has had other contexts
        for batch in batches:
            a, c, d, p, s, w, rd, rs, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(9))
            if known.any():
                yield out(d[known], p[known], s[known], w[known], rd[known], rs[known], a[known], 1)
                a, c, d, p, s, w = (x[~known] for x in (a, c, d, p, s, w))
            if not len(a):
                continue
            lead = held is not None
            if lead:
                a, c, d, p, s, w = (np.concatenate([np.array([x], y.dtype), y]) for x, y in zip(held[:6], (a, c, d, p, s, w)))
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(first)
            of = at[np.cumsum(first) - 1][~first]
            if len(of):
                jd, jp, js, jn, jrd, jrs = joined(d[~first], p[~first], s[~first], w[~first], d[of], s[of])
                yield out(jd, jp, js, jn, jrd, jrs, np.zeros(len(jd)), 1)
            fa, fd, fp, fs, fn = a[at], d[at], p[at], s[at], w[at]
            several = np.zeros(len(at), bool)
            several[0] = lead and held[6]
            same = fa[1:] == fa[:-1]
            several[1:] |= same
            after = several.copy()
            after[:-1] |= same
            told = np.flatnonzero(after[:-1])
            yield out(fd[told], fp[told], fs[told], fn[told], fd[told], fs[told], fa[told], 2)
            held = (fa[-1], c[at[-1]], fd[-1], fp[-1], fs[-1], fn[-1], bool(several[-1]))
        if held and held[6]:
            a, _, d, p, s, w = (np.array([x]) for x in held[:6])
            yield out(d, p, s, w, d, s, a, 2)

    return own.mapInArrow(stream, FACTOR)


def hot_anchors(factors: DataFrame) -> DataFrame:
    return stage(factors.where("kind = 2").groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")))


def near_to(docs: DataFrame, factors: DataFrame) -> DataFrame:
    """doc_id, rep and text of the documents of factors, and few others."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(factors.select("doc_id").distinct()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(zero_copy_only=False), bitmap.value)))

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "rep", "text").mapInArrow(near, "doc_id long, rep long, text string")


def finer(docs: DataFrame, factors: DataFrame, symbols: Symbols, width: int, k: int, n: int, collapse: bool = True) -> DataFrame:
    """Factors, where the runs of anchors of more than HOT are dealt once more, by anchors of k symbols.  A short line that stands
    in many texts makes its anchor hot, but few windows around it repeat: those without a longer anchor in common go here, as
    hashes, before their symbols are sent.  Equal windows have equal anchors of any length, so none that repeats is lost."""
    hot = hot_anchors(factors)
    n_hot = hot.count()
    if not n_hot:
        return factors
    hot = F.broadcast(hot) if n_hot <= 1 << 18 else hot
    own = factors.where("kind = 2").join(hot, "anchor", "left_semi").select("doc_id", "rep", "start", "n")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for ids, buf, offs, part in chunks(batch):
                s, at = lists(part.column(3))
                m, _ = lists(part.column(4))
                values, before = symbols(buf, offs)
                first = np.repeat(before[:-1], np.diff(at)) + s
                past = first + m
                apart = first[1:] != past[:-1]
                r = _runs_of(ids, _long(part.column(1)), values, before, width, k, collapse, (first[np.append(True, apart)], past[np.append(apart, True)]))
                if r:
                    parts.append(r)
            if parts:
                yield from _dealt({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    f = own.groupBy("doc_id", "rep").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("f"))
    dealt = near_to(docs, own).join(f, ["doc_id", "rep"]).select("doc_id", "rep", "text", F.col("f.start").alias("start"), F.col("f.n").alias("n")).mapInArrow(deal, RUN)
    again = stage(judge(dealt, n).select(*factors.columns), release=True)
    return factors.where("kind = 1").unionByName(factors.where("kind = 2").join(hot, "anchor", "left_anti").select(*factors.columns)).unionByName(again)


def contexts(docs: DataFrame, factors: DataFrame, symbols: Symbols, spans, width: int, collapse: bool = True) -> DataFrame:
    """Rows of CONTEXT for the runs (factors of kind 2).  spans(buf, offs): where symbols start and end in the bytes.  The key
    is the run's anchor; runs of an anchor of more than HOT are cut into windows, with their hash for a key."""
    own = factors.where("kind = 2").select("doc_id", "rep", "start", "n", "anchor")
    hot = hot_anchors(factors)
    n_hot = hot.count()
    own = own.join(F.broadcast(hot) if n_hot <= 1 << 18 else hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if n_hot else own.withColumn("hot", F.lit(False))

    def rows(raw, lo, hi, key, d, p, s, n) -> pa.RecordBatch:
        none = np.zeros(len(d), np.int32)
        text = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())
        return pa.RecordBatch.from_pydict({"key": key, "doc_id": d, "rep": p, "start": s.astype(np.int32), "n": n.astype(np.int32), "context": text, "ref_doc": none.astype(np.int64), "ref_start": none, "known": none == 1})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, offs, part in chunks(batch):
                s, at = lists(part.column(3))
                n, a, h = (lists(part.column(i))[0] for i in (4, 5, 6))
                doc = np.repeat(np.arange(len(ids)), np.diff(at))
                begin, end, before = spans(buf, offs)
                d, p, raw = ids.astype(np.int64)[doc], _long(part.column(1))[doc], buf.tobytes()
                g, h = before[doc] + s, h.astype(bool)
                cold = ~h
                yield rows(raw, begin(g[cold]), end(g[cold] + n[cold] + width - 2), a[cold], d[cold], p[cold], s[cold], n[cold])
                if not h.any():
                    continue
                d, p, s, n, g = (x[h] for x in (d, p, s, n, g))
                of, more = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                d, p, s, g = d[of], p[of], s[of] + more, g[of] + more
                key = Ranges(symbols(buf, offs)[0]).hash(g, g + width).view(np.int64)
                r, first, like = _first_alike({"anchor": key, "context": key if collapse else np.arange(len(key)), "doc_id": d, "rep": p, "start": s, "g": g})
                d, p, s, g, key = (r[k] for k in ("doc_id", "rep", "start", "g", "anchor"))
                yield rows(raw, begin(g[first]), end(g[first] + width - 1), key[first], d[first], p[first], s[first], np.ones(int(first.sum())))
                if len(like):
                    d, p, s, n, rd, rs = joined(d[~first], p[~first], s[~first], np.ones(len(like), np.int32), d[like], s[like])
                    yield pa.RecordBatch.from_pydict({"key": mix(d.view(U) + s.astype(U)).view(np.int64), "doc_id": d, "rep": p, "start": s.astype(np.int32), "n": n, "context": pa.nulls(len(d), pa.binary()), "ref_doc": rd, "ref_start": rs.astype(np.int32), "known": np.ones(len(d), bool)})

    f = own.groupBy("doc_id", "rep").agg(F.sort_array(F.collect_list(F.struct("start", "n", "anchor", "hot"))).alias("f"))
    return near_to(docs, factors.where("kind = 2")).join(f, ["doc_id", "rep"]).select("doc_id", "rep", "text", *[F.col(f"f.{c}").alias(c) for c in ("start", "n", "anchor", "hot")]).mapInArrow(cut, CONTEXT)


def with_factors(docs: DataFrame, factors: DataFrame) -> DataFrame:
    """doc_id and text of every row, with starts, ns, ref_docs and ref_starts of its factors, in order of start."""
    own = factors.groupBy("doc_id", "rep").agg(F.sort_array(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start"))).alias("f"))
    return docs.join(own, ["doc_id", "rep"], "left").select("doc_id", "text", *[F.col(f"f.{c}").alias(c) for c in ("start", "n", "ref_doc", "ref_start")])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of an Arrow list column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def covered(size: int, starts: np.ndarray, ns: np.ndarray, width: int) -> np.ndarray:
    """Which of size symbols lie in the windows."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + ns - 1 + width, size), -1)
    return np.cumsum(change[:-1]) > 0
