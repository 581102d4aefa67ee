"""N-gram Jaccard join: all links between word-shingle sets of Jaccard similarity 0.8 or more, as components.

Set relations save work at three levels (set-relation skipping).

*Sets.* Documents of one set share its answers; only the smallest doc_id of each set takes part.

*Index.* Sets are lists of shingle hashes in one order.  A pair of at least the similarity shares L(n) of the first
n - ceil(0.8 n) + L(n) hashes of either, so only those are dealt out; hashes that occur once are skipped, and sets with too
few others can have no partner.  Of the rest, in order of rarity, each set enters the lists of the first only, as many as make
a common list certain.  An entry holds the set's size and the hash's position: how many of the set's dealt hashes stand
before it and after it.  Two entries of a list can share no more hashes than the fewer before, the fewer after and this one;
where that is less than L of the smaller, the sets aren't linked.  Lists stand in order of set size and position and are
skipped through in blocks: a block ends where sets get too large for its head, and the runs in it whose position rules the
head out are passed over without a look at the sets.

*Answers.* In a block the other sets are compared with its head, not with each other: those that match it have its answers,
their component.  Lists that hold several components get further heads while these join much.  What is left are pairs of
one list whose components still differ.  They are derived from the answers
of the heads: distance (1 - similarity) is a metric, so a pair is skipped if its distances from a common head differ by
more than 0.2, if their positions rule them out, or if parity sketches of the sets differ in more bits than sets so similar can; all
others are compared.

Every comparison is exact on whole sets of 64-bit shingle hashes.  No list, block or partner count is capped.

Nulls: a null or empty text, or one of spaces only, has an empty set, is linked with nothing and is its own component.
Rows with a null id are left out; doc_id identifies a document (of repeated rows of an id one is returned).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_bitmap, in_bitmap, shuffle_parts, stage
from ._graph import components
from ._repeats import chunks
from ._vec import BASE, LOWER, U, mix, word_hashes, word_spans

WORDS = 5
SHARE = 80
#: Counts above this are taken as equal; bounds what a task holds of one list.
LONG = 4096
#: Bits of a set's sketch.
SKETCH = 1024


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 offsets."""
    starts, ends, before = word_spans(buf := LOWER[buf], offs)
    h = word_hashes(buf, starts, ends)
    size = np.diff(before)
    v = np.zeros(len(h), U)
    for j in range(WORDS):
        part = h[j:]
        v[: len(part)] = v[: len(part)] * U(BASE) + part
    place = np.arange(len(h))
    doc = np.repeat(np.arange(len(size)), size)
    ok = place + WORDS <= before[doc + 1]
    values, of = mix(v[ok]), doc[ok]
    few = np.flatnonzero((size > 0) & (size < WORDS))
    if len(few):  # the whole sequence, told from longer ones by its length
        whole = np.zeros(len(few), U)
        for j in range(WORDS - 1):
            more = size[few] > j
            whole[more] = whole[more] * U(BASE) + h[before[few[more]] + j]
        values, of = np.concatenate([values, mix(whole + size[few].astype(U))]), np.concatenate([of, few])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(len(size) + 1))


def need(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-SHARE * n // 100)


def _level(n: np.ndarray) -> np.ndarray:
    """How many of the dealt hashes a pair shares at least: more are dealt (half of a set), and sets with fewer common ones go."""
    return np.maximum(1, 3 * n // 10)


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCH bits of each set, as rows of 64-bit numbers: bit b is the parity of the hashes that fall on b.  Sketches differ
    in no more bits than the sets in hashes."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros((n, SKETCH // 64), np.int64)
    for a in range(0, n, 1024):  # so many sets at a time
        b = min(n, a + 1024)
        own = slice(at[a], at[b])
        odd = np.bincount((of[own] - a) * SKETCH + (values[own] % U(SKETCH)).astype(np.int64), minlength=(b - a) * SKETCH) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, SKETCH), axis=1).view(np.int64)
    return out


def _digests(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[U(0)], np.cumsum(mix(values ^ U(BASE)), dtype=U)])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.diff(at).astype(U)))


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and sid (hash of the set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, offs, _ in chunks(batch):
                values, at = shingle_sets(buf, offs)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.astype(np.int64), "n": np.diff(at), "sid": _digests(values, at).view(np.int64)})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(each, "doc_id long, n long, sid long")


def _dealt(docs: DataFrame) -> DataFrame:
    """(token, doc_id, n) for the first hashes of each set; of equal sets of a batch, the first row's only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set = set()
            for ids, buf, offs, _ in chunks(batch):
                values, at = shingle_sets(buf, offs)
                n, sid = np.diff(at), _digests(values, at)
                first = np.zeros(len(n), bool)
                for i in np.argsort(ids, kind="stable").tolist():
                    if (s := int(sid[i])) not in seen:
                        seen.add(s)
                        first[i] = n[i] > 0
                take = np.where(first, n - need(n) + _level(n), 0)
                take = np.minimum(take, n)
                of = np.repeat(np.arange(len(n)), take)
                pick = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(int(take.sum()))
                yield pa.RecordBatch.from_pydict({"token": values[pick].view(np.int64), "doc_id": ids[of].astype(np.int64), "n": n[of].astype(np.int32)})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(each, "token long, doc_id long, n int")


def _shared(dealt: DataFrame, parts: int) -> DataFrame:
    """Tokens in more than one set, with their count (LONG at most): (doc_id, n, token, df)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last token, LONG at most
        long = None  # the last token, if over LONG of its rows have been told
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
            t, d, n = rows
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            count = np.diff(np.append(head, len(t)))
            if t[0] == long:
                count[0] = LONG + 1
            end = len(t) if count[-1] > LONG else int(head[-1])
            long, held = (t[-1], None) if end == len(t) else (None, [x[end:] for x in rows])
            df = np.repeat(np.minimum(count, LONG), np.diff(np.append(head, len(t))))[:end]
            ready = np.flatnonzero(df > 1)
            yield pa.RecordBatch.from_pydict({"doc_id": d[ready], "n": n[ready], "token": t[ready], "df": df[ready].astype(np.int32)})
        if held and len(held[0]) > 1:
            yield pa.RecordBatch.from_pydict({"doc_id": held[1], "n": held[2], "token": held[0], "df": np.full(len(held[0]), len(held[0]), np.int32)})

    return dealt.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(stream, "doc_id long, n int, token long, df int")


def _rarest(shared: DataFrame, standing_for: DataFrame) -> DataFrame:
    """The lists that each set enters, with its place in them: (token, doc_id, n, before, after).  before and after count the
    dealt hashes of the set around this one.  standing_for: (doc_id, first) names each set by its first document."""
    n = F.col("n").cast("long")
    least = F.ceil(n * SHARE / 100)
    dealt = F.least(n, n - least + F.greatest(F.lit(1), F.floor(3 * n / 10)))
    common = F.greatest(F.lit(1), F.floor(3 * least / 10))
    each = shared.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    enter = (F.size("t") - common + 1).cast("int")  # unique tokens, which stand first, are skipped
    each = each.where(enter > 0).select("doc_id", "n", F.size("t").alias("of"), F.slice("t", F.lit(1), enter).alias("t")).join(standing_for, "doc_id")
    rows = each.select(F.posexplode("t").alias("before", "t"), "first", "n", "of")
    return rows.select("t.token", F.col("first").alias("doc_id"), "n", "before", (F.col("of") - 1 - F.col("before")).alias("after")).distinct()


def _heads(lists: DataFrame, parts: int) -> DataFrame:
    """(token, head, doc_id, before, after, near, skip): each block's head with the sets after it; the head with itself.  near:
    by its size the set may be linked to the one before it in the list, which heads of blocks of one set can be too.  skip: by
    its position it can't be linked to the head."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, last, head = None, 0, [0, 0, 0, 0]  # of the row before this batch; its head's doc_id, n, before, after
        for batch in batches:
            if not batch.num_rows:
                continue
            t, d, n, before, after = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            n = n.astype(np.int64)
            same = np.concatenate([[token is not None and t[0] == token], t[1:] == t[:-1]])
            near = same & (100 * np.concatenate([[last], n[:-1]]) >= SHARE * n)
            begin = np.flatnonzero(~same)
            if same[0]:
                begin = np.concatenate([[0], begin])
            end = np.append(begin[1:], len(t))
            at = np.repeat(begin, end - begin)  # where the row's head is; -1: before this batch
            blocks = 100 * n[begin] // SHARE < n[end - 1]  # lists of more than one
            blocks[0] |= same[0]
            for i, b in zip(begin[blocks].tolist(), end[blocks].tolist()):
                if same[i]:
                    i = int(np.searchsorted(n[:b], 100 * head[1] // SHARE, side="right"))
                    at[:i] = -1
                while i < b:  # a block at a time
                    j = i + int(np.searchsorted(n[i:b], 100 * n[i] // SHARE, side="right"))
                    at[i:j] = i
                    i = j
            of = [np.append(x, y)[at] for x, y in zip((d, n, before, after), head)]
            # the head is the smallest of its block: a link shares its level of dealt hashes at least
            skip = (d != of[0]) & (np.minimum(before, of[2]) + 1 + np.minimum(after, of[3]) < _level(of[1]))
            token, last, head = t[-1], int(n[-1]), [int(x[-1]) for x in of]
            yield pa.RecordBatch.from_pydict({"token": t, "head": of[0], "doc_id": d, "before": before, "after": after, "near": near, "skip": skip})

    rows = lists.select("token", "doc_id", "n", "before", "after").repartition(parts, "token").sortWithinPartitions("token", "n", "before", "after", "doc_id")
    return rows.mapInArrow(stream, "token long, head long, doc_id long, before int, after int, near boolean, skip boolean")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) to (a, b, both, union), from the whole sets."""
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    d = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("ha") + F.size("hb") - both).alias("either"))
    return d


def _linked() -> Column:
    return 100 * F.col("both") >= SHARE * F.col("either")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the wanted; a bitmap of bounded size spares most others the shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(zero_copy_only=False), bitmap.value)))
            for ids, buf, offs, _ in chunks(own):
                values, at = shingle_sets(buf, offs)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64))), pa.array(list(sketches(values, at)), pa.list_(pa.int64()))], names=["doc_id", "hashes", "sketch"])

    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(each, "doc_id long, hashes array<long>, sketch array<long>")
    return sets.join(wanted, "doc_id", "left_semi")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, sid and component_id."""
    parts = shuffle_parts(docs.sparkSession)
    own = stage(set_rows(docs).groupBy("doc_id").agg(F.max("n").alias("n"), F.max_by("sid", "n").alias("sid")))
    first = stage(own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    standing_for = own.join(first.withColumnRenamed("doc_id", "first"), "sid").select("doc_id", "first")
    headed = stage(_heads(_rarest(_shared(_dealt(docs), parts), standing_for), parts))
    pairs = headed.where("head <> doc_id AND NOT skip").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    # whoever may have a partner by size: those of pairs, and those near the set before them in a list
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(headed.where("near").select("doc_id")).distinct())
    sets = stage(_whole_sets(docs, wanted))
    known = stage(_compared(pairs, sets))
    links = known.where(_linked()).select("a", "b")
    label = stage(components(links))
    again = 0
    while True:  # other heads, as long as they join much: a large group is connected before its pairs are looked at
        m = _mixed(headed, known, label, sets)
        fresh = stage(_compared(_other_heads(m, again), sets).where(_linked()).select("a", "b"))
        found, open_ = fresh.count(), m.select("doc_id").distinct().count()
        if found:
            label = stage(components(label.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(fresh)))
        again += 1
        if 20 * found < open_ or not open_:
            break
    fresh = stage(_compared(_open_pairs(_mixed(headed, known, label, sets), known), sets).where(_linked()).select("a", "b"))
    if not fresh.isEmpty():
        label = stage(components(label.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(fresh)))
    top = label.select(F.col("v").alias("doc_id"), "component")
    by_set = first.join(top, "doc_id", "left").select("sid", F.coalesce("component", "doc_id").alias("component"))
    return own.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), "sid", F.coalesce("component", "doc_id").alias("component_id"))


def _mixed(headed: DataFrame, known: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists that hold several components: (token, head, doc_id, component, n, before, after, far, sketch); far: distance
    from the head, null if they were not compared."""
    size = sets.select("doc_id", F.size("hashes").alias("n"), "sketch")
    rows = headed.join(label.select(F.col("v").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    lists = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    far = known.select(F.col("a").alias("head"), F.col("b").alias("doc_id"), (1 - F.col("both") / F.col("either")).alias("far"))
    m = rows.join(lists, "token").join(far, ["head", "doc_id"], "left").join(size, "doc_id")
    far = F.when(F.col("head") == F.col("doc_id"), F.lit(0.0)).otherwise(F.col("far"))
    return stage(m.select("token", "head", "doc_id", "component", "n", "before", "after", far.alias("far"), "sketch"))


ENTRY = ("doc_id", "component", "n", "before", "after", "sketch")


def _sides(m: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    x, y = (m.select("token", *[F.col(c).alias(f"{k}_{c}") for c in (*ENTRY, *columns)]) for k in "xy")
    return x, y


def _possible() -> Column:
    """Different components, and neither sizes nor positions nor sketches rule a link out."""
    differ = sum((F.bit_count(F.get("x_sketch", F.lit(i)).bitwiseXOR(F.get("y_sketch", F.lit(i)))) for i in range(1, SKETCH // 64)), F.bit_count(F.get("x_sketch", F.lit(0)).bitwiseXOR(F.get("y_sketch", F.lit(0)))))
    sizes = 100 * F.least("x_n", "y_n") >= SHARE * F.greatest("x_n", "y_n")
    shared = F.least("x_before", "y_before") + 1 + F.least("x_after", "y_after")
    places = shared >= F.greatest(F.lit(1), F.floor(3 * F.least("x_n", "y_n") / 10))
    return (F.col("x_component") != F.col("y_component")) & sizes & places & ((100 + SHARE) * differ <= (100 - SHARE) * (F.col("x_n") + F.col("y_n")))


def _other_heads(m: DataFrame, again: int) -> DataFrame:
    """One more head for each list, in pseudo-random turn, with the sets it may be linked to."""
    turn = F.xxhash64("token", "doc_id", F.lit(again))
    row = F.struct(*[F.col(c) for c in ENTRY])
    head = m.groupBy("token").agg(F.min_by(row, turn).alias("x")).select("token", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ENTRY])
    return head.join(_sides(m)[1], "token").where(_possible()).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def _open_pairs(m: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of one list in different components which sizes, sketches and distances from heads don't rule out."""
    x, y = _sides(m, "head", "far")
    apart = 1 - SHARE / 100 + 1e-9
    near = (F.col("x_head") != F.col("y_head")) | F.coalesce((F.abs(F.col("x_far") - F.col("y_far")) <= apart), F.lit(True))
    pairs = x.join(y, "token").where((F.col("x_doc_id") < F.col("y_doc_id")) & near & _possible()).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti").join(known.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
