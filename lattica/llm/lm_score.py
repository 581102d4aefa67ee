"""LM scoring with log-frequency Bloom filters.

Counts of words and pairs of training texts are quantised to levels, 1 + floor(log2 c), and a filter holds (n-gram, 1) ..
(n-gram, level).  There is one for words and one for pairs, both in 4096 segments; each segment is built by the task that
gathers the n-grams of its share of hashes, with ``per_entry`` bits for each level of each n-gram that it turns out to
hold, so the filters grow with the corpus and are equally full at any size.  All pairs are held, unless ``least_pairs``
says otherwise.  Scoring probes (n-gram, 1), (n-gram, 2) ... until one is missing or the highest level held is reached; the
count is read as the middle of the last level found, 1.5 * 2**(level - 1), or 1 or 0.  Pair probabilities are smoothed with
the word's (a Dirichlet prior of weight ``mu``), the word's by adding 1.

The filter of words is broadcast whole.  That of pairs is broadcast ``slice_bits`` at a time: texts are read once for each
slice, and the shares of their scores are added up.

The base score needs exact counts: those of the most frequent words, ``head`` at most, are broadcast, which serves most tokens and
every hot one; the rest, with low counts each, are joined.

Nulls: a null text is empty: one token, the end.  Rows with a null id aren't trained on and score like others, except
that rows are matched by id: repeated rows of one id are returned once for each row, and train as often.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shuffle_parts, stage
from ._repeats import chunks
from ._vec import BASE, LOWER, U, mix, word_hashes, word_spans

END, START = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
#: Shares of the hashes, by their leading bits.
SEGMENTS, SHIFT = 4096, U(52)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then the end, for each text), of what stands before each, and n + 1 offsets."""
    starts, ends, before = word_spans(buf := LOWER[buf], offs)
    size = np.diff(before) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    seq = np.empty(at[-1], U)
    last = np.zeros(len(seq), bool)
    last[at[1:] - 1] = True
    seq[~last], seq[last] = word_hashes(buf, starts, ends), END
    prev = np.empty_like(seq)
    prev[1:] = seq[:-1]
    prev[at[:-1]] = START
    return seq, prev, at


def pair_hashes(prev: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return mix(prev * U(BASE) + seq + U(1))


@dataclass
class Filter:
    bits: np.ndarray  # packed
    at: np.ndarray  # where the bits of each segment start, and the end; segments that aren't here have none
    hashes: int
    top: int  # highest level held

    @property
    def fill(self) -> float:
        return float(np.unpackbits(self.bits[: 1 << 20]).mean()) if len(self.bits) else 0.0

    def plain(self) -> tuple:
        return self.bits, self.at, self.hashes, self.top

    def levels(self, keys: np.ndarray) -> np.ndarray:
        start, per = self.at[:-1], np.diff(self.at)
        segment = (keys >> SHIFT).astype(np.int64)
        out, live, level = np.zeros(len(keys), np.int16), np.flatnonzero(per[segment] > 0), 1
        while len(live) and level <= self.top:
            k, s = keys[live], segment[live]
            there = np.ones(len(k), bool)
            for at in places(k, level, self.hashes, per[s]):
                at = start[s] + at
                there &= (self.bits[(at >> U(3)).astype(np.int64)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
            live = live[there]
            out[live] = level
            level += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        level = self.levels(keys).astype(np.float64)
        return np.where(level <= 1, level, 1.5 * 2.0 ** (level - 1))


@dataclass
class Model:
    words: Filter
    fields: DataFrame  # the segments of both filters
    sizes: list  # (segment, bits, highest level) of the pairs' filter, in order
    hashes: int
    n: int  # training tokens
    v: int  # distinct ones

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.words.counts(keys)

    def slices(self, bits: int) -> Iterator[tuple[int, int, Filter]]:
        """The pairs' filter, so many bits at a time (one segment at least): first segment, the one after the last, and the part."""
        cuts, held = [0], 0
        for segment, size, _ in self.sizes:
            if held and held + size > bits:
                cuts.append(segment)
                held = 0
            held += size
        for first, end in zip(cuts, [*cuts[1:], SEGMENTS]):
            yield first, end, _loaded(self.fields.where(f"NOT word AND segment >= {first} AND segment < {end}"), [x for x in self.sizes if first <= x[0] < end], self.hashes)


def _loaded(fields: DataFrame, sizes: list, hashes: int) -> Filter:
    per = np.zeros(SEGMENTS, np.int64)
    for segment, size, _ in sizes:
        per[segment] = size
    at = np.concatenate([[0], np.cumsum(per)])
    bits = np.zeros(int(at[-1]) // 8, np.uint8)
    for r in fields.select("segment", "bits").toLocalIterator():
        bits[at[r.segment] // 8: at[r.segment + 1] // 8] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits, at.astype(U), hashes, max((top for _, _, top in sizes), default=0))


def places(keys: np.ndarray, level: int, hashes: int, per: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(hashes):
        yield mix(keys + U((level * 64 + i + 1) * BASE & (2**64 - 1))) % per


def quantised(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)


def _gathered(docs: DataFrame) -> DataFrame:
    """(segment, word, key, n): n-grams of the training texts, counted within each batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, pairs, texts = [], [], 0
            for _, buf, offs, _ in chunks(batch):
                seq, prev, at = tokens(buf, offs)
                words.append(np.unique(seq, return_counts=True))
                pairs.append(pair_hashes(prev, seq))
                texts += len(at) - 1
            if not texts:
                continue
            keys, n = (np.concatenate(x) for x in zip(*words))
            keys, inverse = np.unique(np.append(keys, START), return_inverse=True)
            n = np.bincount(inverse, np.append(n, texts)).astype(np.int64)
            two, m = np.unique(np.concatenate(pairs), return_counts=True)
            for word, k, c in ((True, keys, n), (False, two, m)):
                yield pa.RecordBatch.from_pydict({"segment": (k >> SHIFT).astype(np.int32), "word": np.full(len(k), word), "key": k.view(np.int64), "n": c.astype(np.int64)})

    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text").mapInArrow(each, "segment int, word boolean, key long, n long")


def _built(gathered: DataFrame, parts: int, bits: int | None, per_entry: int, hashes: int, least_pairs: int) -> DataFrame:
    """Rows (segment, word, bits, top, key, n): the bits and the highest level of each segment of either filter, and each
    word with its count.  Streams sorted partitions and holds the n-grams of one segment."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, got, held = None, [], None

        def row(segment, word, field, top, key, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(word, pa.bool_()), pa.array(field, pa.binary()), pa.array(top, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["segment", "word", "bits", "top", "key", "n"])

        def told() -> pa.RecordBatch:
            keys, n = (np.concatenate(x) for x in zip(*got))
            keep = n >= (1 if own[1] else least_pairs)
            keys, level = keys[keep].view(U), quantised(n[keep])
            top = int(level.max(initial=0))
            per = bits // SEGMENTS if bits else max(64, -(-per_entry * int(level.sum()) // 8) * 8)
            field = np.zeros(per, bool)
            at = 1
            while len(keys):
                for p in places(keys, at, hashes, U(per)):
                    field[p.astype(np.int64)] = True
                at += 1
                keys, level = keys[level >= at], level[level >= at]
            return row([own[0]], [own[1]], [np.packbits(field).tobytes()], [top], [None], [None])

        def insert(s, w, k, n) -> Iterator[pa.RecordBatch]:
            nonlocal own, got
            cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])])) if len(s) else np.zeros(0, int)
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(s)).tolist()):
                if own != (int(s[a]), bool(w[a])):
                    if own is not None:
                        yield told()
                    own, got = (int(s[a]), bool(w[a])), []
                got.append((k[a:b], n[a:b]))
            words = w & (k != START.view(np.int64))
            none = [None] * int(words.sum())
            yield row(none, none, none, none, k[words], n[words])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
            s, w, k, n = rows
            head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]))
            total = np.add.reduceat(n, head)
            s, w, k = s[head], w[head], k[head]
            yield from insert(s[:-1], w[:-1], k[:-1], total[:-1])
            held = [s[-1:], w[-1:], k[-1:], total[-1:]]
        if held:
            yield from insert(*held)
            yield told()

    return gathered.repartition(parts, "segment").sortWithinPartitions("segment", "word", "key").mapInArrow(stream, "segment int, word boolean, bits binary, top int, key long, n long")


def fit(docs: DataFrame, bits: int | None = None, hashes: int = 4, least_pairs: int = 1, per_entry: int = 8) -> tuple[Model, DataFrame]:
    """The filters, and the table (key, n) of words.  bits: a fixed size of each filter, whatever it holds."""
    built = stage(_built(_gathered(docs), shuffle_parts(docs.sparkSession), bits, per_entry, hashes, least_pairs))
    words = built.where("key IS NOT NULL").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    fields = built.where("segment IS NOT NULL").select("segment", "word", "bits", "top")
    sizes = sorted((r.word, r.segment, 8 * r.size, r.top) for r in fields.select("segment", "word", F.octet_length("bits").alias("size"), "top").collect())
    of = {k: [x[1:] for x in sizes if x[0] == k] for k in (False, True)}
    return Model(_loaded(fields.where("word"), of[True], hashes), fields, of[False], hashes, int(total[0]), int(total[1])), words


def _threshold(words: DataFrame, head: int) -> int:
    """A count that no more than ``head`` words reach, from a histogram of counts on a scale of eighths of powers of 2."""
    size = F.floor(8 * F.log2(F.col("n").cast("double")))
    level, left = words.groupBy(size.alias("size")).agg(F.min("n").alias("n"), F.count("*").alias("k")).collect(), head
    out = 1 << 62
    for r in sorted(level, key=lambda r: -r.size):
        left -= r.k
        if left < 0:
            break
        out = r.n
    return out


def _row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0, x.dtype)


def score(docs: DataFrame, mu: float = 1000.0, head: int = 1 << 17, slice_bits: int = 1 << 30, **filter_options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    model, words = fit(docs, **filter_options)
    n, v = model.n, model.v
    top = words.where(F.col("n") >= _threshold(words, head)).collect()
    top_keys, top_n = np.array([r.key for r in top], np.int64).view(U), np.array([r.n for r in top], np.int64)
    order = np.argsort(top_keys)
    texts, context = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), docs.sparkSession.sparkContext
    heads = context.broadcast((top_keys[order], top_n[order]))

    def logs(m, seq, prev, at, u, inverse):
        """Logarithms of the pair probabilities, 0 for pairs of other slices."""
        words, first, end, pairs = Filter(*m[0]), m[1], m[2], Filter(*m[3])
        c1 = words.counts(u)
        p1 = (c1 + 1) / (n + v + 1)
        h1 = np.empty(len(seq))
        h1[1:] = c1[inverse][:-1]
        h1[at[:-1]] = words.counts(np.array([START]))[0]
        pu, pi = np.unique(pair_hashes(prev, seq), return_inverse=True)
        own = (pu >> SHIFT >= U(first)) & (pu >> SHIFT < U(end))
        return np.where(own[pi], np.log10(np.minimum((pairs.counts(pu)[pi] + mu * p1[inverse]) / (h1 + mu), 1.0)), 0.0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (tk, tn) = shared.value, heads.value
        for batch in batches:
            for _, buf, offs, part in chunks(batch):
                seq, prev, at = tokens(buf, offs)
                u, inverse = np.unique(seq, return_inverse=True)
                near = np.minimum(np.searchsorted(tk, u), max(len(tk) - 1, 0))
                exact = tk[near] == u if len(tk) else np.zeros(len(u), bool)
                c = np.where(exact, tn[near], 0) if len(tk) else np.zeros(len(u), np.int64)
                base = np.where(exact, np.log10(c + 1.0), 0.0)[inverse]
                tail = np.flatnonzero(~exact[inverse])
                of = np.searchsorted(at, tail, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(np.diff(at)), pa.array(_row_sums(exact[inverse].astype(np.int64), at)), pa.array(_row_sums(base, at)), pa.array(_row_sums(logs(m, seq, prev, at, u, inverse), at)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(at))).astype(np.int32)), pa.array(seq[tail].view(np.int64))),
                ], names=["doc_id", "mark", "n_tokens", "known", "base", "score", "tail"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for _, buf, offs, part in chunks(batch):
                seq, prev, at = tokens(buf, offs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(_row_sums(logs(m, seq, prev, at, *np.unique(seq, return_inverse=True)), at))], names=["doc_id", "mark", "share"])

    d = None
    for first, end, pairs in model.slices(slice_bits):
        shared = context.broadcast((model.words.plain(), first, end, pairs.plain()))  # no classes of ours: workers may lack them
        if d is None:
            d = texts.mapInArrow(each, "doc_id long, mark long, n_tokens long, known long, base double, score double, tail array<long>")
            d = stage(d.withColumn("row", F.monotonically_increasing_id()))
        else:  # a share depends on the text alone; rows of equal id and text have one
            more = stage(texts.mapInArrow(shares, "doc_id long, mark long, share double")).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.first("share").alias("share"))
            added = d.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
            d = stage(added.withColumn("score", F.col("score") + F.col("share")).drop("_id", "_mark", "share"))
        shared.unpersist()
    tail = d.select("row", F.explode("tail").alias("key")).groupBy("row", "key").count()
    tail = tail.join(words, "key").groupBy("row").agg(F.sum("count").alias("more"), F.sum(F.col("count") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"))
    d = d.drop("tail").join(tail, "row", "left")
    return d.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score",
    )
