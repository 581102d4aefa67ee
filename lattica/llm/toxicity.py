"""Toxicity: a convolutional classifier of texts, trained in numpy.

A word's embedding is the sum of three hashed ones: of the word and of its first four and six bytes (so that unseen
inflections share).  Filters of widths 1, 2 and 3 run over the words, each keeps its largest response (max pooling), and
a logistic layer makes the score.  The first embedding component starts from smoothed log odds of its bucket in the
training texts, the others at random.  Only the text is scored; a language's threshold, the one of best F1 on its training
rows, is used for the ``flag`` alone.

It is fitted on all labelled rows outside the fold held out; all texts are scored whole.  Up to ``at_once`` rows are fitted
on the driver.  More are fitted where they lie: their buckets are counted in parts, then in each of ``ROUNDS`` rounds every part
goes on from the same model over all of its rows, and the models are averaged, weighted by rows.  Their thresholds come from
counts of all rows by language, class and score, in BINS steps.

Nulls: a null text is empty; empty texts are scored too.  Null ids count as not held out.  Labels: null ones are ignored,
of repeated rows the largest counts.  Without labelled rows of both classes every score is the training share (or 0).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_bitmap, in_bitmap, stage
from ._repeats import chunks
from ._vec import LOWER, pack, word_hashes, word_spans

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
PAD = 3 * BUCKETS
#: Passes over rows fitted in parts, how many parts at most (a model each comes to the driver), and steps of scores.
ROUNDS, PARTS, BINS = 4, 16, 1 << 14
#: Bytes between words: ASCII that is neither letter nor digit.
APART = np.zeros(256, bool)
APART[:128] = True
APART[48:58] = APART[65:91] = APART[97:123] = False


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bucketed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three buckets for each word, with two pads after each text; n + 1 offsets."""
    starts, ends, before = word_spans(buf := LOWER[buf], offs, APART)
    n = np.diff(before)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full((at[-1], 3), PAD, np.int32)
    place = np.arange(len(starts)) + 2 * np.repeat(np.arange(len(n)), n)
    for i, cut in enumerate((1 << 30, 4, 6)):
        out[place, i] = (word_hashes(buf, starts, np.minimum(ends, starts + cut)) >> np.uint64(40)).astype(np.int64) % BUCKETS + i * BUCKETS
    return out, at


class Cnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = np.zeros((3 * BUCKETS + 1, DIM), np.float32)
        self.emb[:-1] = r.normal(0, 0.05, (3 * BUCKETS, DIM))
        self.conv = [r.normal(0, 0.3 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[0, 0, :] = np.abs(c[0, 0, :]) + 0.3
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.shift = np.float32(0)
        self.constant: float | None = None

    @classmethod
    def of(cls, parts: dict) -> Cnn:
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each width, at each word; the last words lean on the pads."""
        out = []
        for w, c in zip(WIDTHS, self.conv):
            r = x @ c[0]
            for j in range(1, w):
                r[:-j] += (x @ c[j])[j:]
            out.append(r)
        return out

    def pooled(self, rows: np.ndarray, at: np.ndarray, places: bool = False):
        x = self.emb[rows].sum(1)
        # windows start at the words, or at the first pad of an empty text: the pads after words are left out
        start, stop = at[:-1], np.maximum(at[1:] - 2, at[:-1] + 1)
        cuts = np.stack([start, stop], 1).ravel()
        m, where = [], []
        for r in self._responses(x):
            top = np.maximum.reduceat(r, np.minimum(cuts, len(r) - 1), axis=0)[::2]
            m.append(top)
            if places:
                where.append(np.stack([a + r[a:b].argmax(0) for a, b in zip(start, stop)]))
        f = np.concatenate(m, 1) + self.bias
        return (f, where, x) if places else f

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        f = np.maximum(self.pooled(rows, at), 0)
        return 1 / (1 + np.exp(-np.clip(f @ self.out + self.shift, -30, 30))).astype(np.float64)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Cnn:
        pos = int(y.sum())
        if not 0 < pos < len(y):
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        self.start(seen_in(docs, y), pos, len(y))
        return self.descend(docs, y, epochs, batch, rate, seed)

    def start(self, seen: np.ndarray, pos: int, n: int) -> None:
        """From counts of texts by class and bucket."""
        neg = n - pos
        odds = np.log((seen[1] + 0.1) / (pos + 0.2)) - np.log((seen[0] + 0.1 * neg / pos) / (neg + 0.2 * neg / pos))
        self.emb[:-1, 0] = 0.4 * np.clip(odds * np.sqrt(np.minimum(seen.sum(0) / 5, 1)), -4, 4)[:-1]
        self.shift = np.float32(np.log(pos / neg) - 1)

    def descend(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 7, g2: dict | None = None) -> Cnn:
        """Adaptive steps over the texts; ``g2``, the sums of squares they go by, is changed in place."""
        rng = np.random.default_rng(seed)
        g2 = self.squares() if g2 is None else g2
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), batch):
                own = order[k: k + batch]
                rows = np.concatenate([docs[i] for i in own])
                at = np.concatenate([[0], np.cumsum([len(docs[i]) for i in own])])
                f, where, x = self.pooled(rows, at, True)
                a = np.maximum(f, 0)
                p = 1 / (1 + np.exp(-np.clip(a @ self.out + self.shift, -30, 30)))
                e = ((p - y[own]) / len(own)).astype(np.float32)
                da = np.outer(e, self.out) * (f > 0)
                grads = {"out": a.T @ e + 1e-4 * self.out, "shift": e.sum(), "bias": da.sum(0)}
                dx: list[tuple[np.ndarray, np.ndarray]] = []
                for i, (w, c) in enumerate(zip(WIDTHS, self.conv)):
                    d = da[:, i * FILTERS: (i + 1) * FILTERS]
                    gc = np.zeros_like(c)
                    for j in range(w):
                        at_j = np.minimum(where[i] + j, len(x) - 1)
                        gc[j] = np.einsum("nfd,nf->df", x[at_j], d)
                        dx.append((at_j.ravel(), (d[:, :, None] * c[j].T[None]).reshape(-1, DIM)))
                    g2["conv"][i] += gc * gc
                    c -= rate * gc / np.sqrt(g2["conv"][i])
                place, g = np.concatenate([p for p, _ in dx]), np.concatenate([q for _, q in dx])
                ids, inverse = np.unique(rows[place].ravel(), return_inverse=True)
                ge = np.zeros((len(ids), DIM), np.float32)
                np.add.at(ge, inverse, np.repeat(g, 3, axis=0))
                ge[ids == PAD] = 0
                g2["emb"][ids] += ge * ge
                self.emb[ids] -= rate * ge / np.sqrt(g2["emb"][ids])
                for name in ("out", "bias", "shift"):
                    g2[name] = g2[name] + grads[name] ** 2
                    setattr(self, name, (getattr(self, name) - rate * grads[name] / np.sqrt(g2[name])).astype(np.float32))
        return self


    def squares(self) -> dict:
        return {"emb": np.full_like(self.emb, 1e-2), "bias": np.full_like(self.bias, 1e-2), "out": np.full_like(self.out, 1e-2), "shift": np.float32(1e-2), "conv": [np.full_like(c, 1e-2) for c in self.conv]}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.emb, *self.conv, self.bias, self.out, np.array([self.shift]))]).astype(np.float32)

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (self.emb, *self.conv, self.bias, self.out):
            x[...] = flat[at: at + x.size].reshape(x.shape)
            at += x.size
        self.shift = np.float32(flat[at])


def seen_in(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Texts of each class that hold each bucket."""
    seen = np.zeros((2, 3 * BUCKETS + 1))
    for d, t in zip(docs, y):
        seen[int(t), np.unique(d)] += 1
    return seen


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Of best F1; 0.5 if a class is absent."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-score)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = score[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((score[order[k]] + below) / 2)


def best_step(n: np.ndarray, hits: np.ndarray) -> float:
    """Of best F1, from counts of all rows and of those of class 1 by step of the score; 0.5 if a class is absent."""
    if not 0 < hits.sum() < n.sum():
        return 0.5
    at = np.cumsum(hits[::-1])[::-1]
    return float((2 * at / (np.cumsum(n[::-1])[::-1] + hits.sum())).argmax() / len(n))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic of all labelled rows outside the fold held out.  Only texts whose id may have a label are shuffled."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(own))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy(zero_copy_only=False), bitmap.value)))

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(lang, F.lit("")).alias("lang"))
    return rows.mapInArrow(near, "doc_id long, text string, lang string").join(own, "doc_id")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    for _, buf, offs, part in chunks(batch):
        rows, at = bucketed(buf, offs)
        yield [rows[a:b] for a, b in zip(at, at[1:])], part.column(3).to_numpy(zero_copy_only=False)


def _fit_in_parts(rows: DataFrame, pos: int, n: int) -> Cnn:
    share = rows.sparkSession.sparkContext.broadcast
    rows = rows.coalesce(PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sum((seen_in(d, y) for batch in batches for d, y in _texts(batch)), np.zeros((2, 3 * BUCKETS + 1)))
        yield pa.RecordBatch.from_pydict({"v": [seen.tobytes()]})

    model = Cnn()
    model.start(sum(np.frombuffer(r.v).reshape(2, -1) for r in rows.mapInArrow(count, "v binary").collect()), pos, n)
    for turn in range(ROUNDS):
        shared = share(vars(model))

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Cnn.of({k: ([c.copy() for c in v] if k == "conv" else v.copy() if isinstance(v, np.ndarray) else v) for k, v in shared.value.items()})
            g2, done = own.squares(), 0
            for batch in batches:
                for d, y in _texts(batch):
                    own.descend(d, y.astype(np.float32), epochs=1, seed=turn, g2=g2)
                    done += len(d)
            if done:
                yield pa.RecordBatch.from_pydict({"n": [done], "v": [own.flat().tobytes()]})

        total = np.zeros(len(model.flat()))
        for r in rows.mapInArrow(go_on, "n long, v binary").collect():
            total += np.frombuffer(r.v, np.float32) * (r.n / n)
        model.put(total)
        shared.unpersist()
    return model


def fit(docs: DataFrame, labels: DataFrame, at_once: int = 12_000) -> tuple[Cnn, dict[str, float]]:
    rows = stage(labelled(docs, labels), release=True)
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n > at_once and 0 < pos < n:
        model = _fit_in_parts(rows, pos, n)
        shared = docs.sparkSession.sparkContext.broadcast(vars(model))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Cnn.of(shared.value)
            for batch in batches:
                for _, buf, offs, part in chunks(batch):
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(np.minimum(m.scores(*bucketed(buf, offs)) * BINS, BINS - 1).astype(np.int32))], names=["lang", "toxic", "bin"])

        steps: dict[str, np.ndarray] = {}
        for r in rows.mapInArrow(score, "lang string, toxic int, bin int").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).toLocalIterator():
            steps.setdefault(r.lang, np.zeros((2, BINS)))[:, r.bin] = r.n, r.hits
        return model, {x: best_step(*steps[x]) for x in sorted(steps)}
    got = sorted(((r.doc_id, r.text or "", r.lang, r.toxic) for r in rows.toLocalIterator()), key=lambda r: (r[0], r[1]))
    texts = [bucketed(*pack(pa.array([r[1]])))[0] for r in got]
    y = np.array([r[3] for r in got], np.float32)
    model = Cnn().fit(texts, y)
    score = np.array([model.scores(t, np.array([0, len(t)]))[0] for t in texts])
    langs = np.array([r[2] for r in got])
    return model, {x: best_threshold(score[langs == x], y[langs == x]) for x in sorted(set(langs.tolist()))}


def score_toxicity(docs: DataFrame, labels: DataFrame, at_once: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more) and flag (at the language's threshold)."""
    model, thresholds = fit(docs, labels, at_once)
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), thresholds))  # no class of ours: workers may lack it

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, limit = Cnn.of(shared.value[0]), shared.value[1]
        for batch in batches:
            for _, buf, offs, part in chunks(batch):
                s = m.scores(*bucketed(buf, offs))
                at = np.array([limit.get(x or "", 0.5) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= at)], names=["doc_id", "score", "predicted", "flag"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(each, "doc_id long, score double, predicted int, flag boolean")
    return d.select("doc_id", held_out().alias("held_out"), "score", "predicted", "flag")
