"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence make a page's posterior: the likelihood of its visible text (hashed words and byte trigrams, naive
Bayes trained on labelled documents, tempered for their dependence); the declared markup language; the address suffix;
and a prior of its host.  How far a declaration is to be trusted is learnt: P(declared | language) comes from grouped sums
of text posteriors.  Priors are smoothed down a hierarchy, all data, suffix, domain, host: each level's counts (again sums
of text posteriors) are topped up with ``strength`` pages of the level above.  A page's own posterior is taken out of its
counts, so it never votes for itself.

The text model is fitted on at most ``max_documents`` labelled documents (smallest crc32 of their id), counted on the driver
one at a time.  Trigrams come from whole words, so a script without spaces is read in full.  Groups are joined, never
collected; a hot host is one row of its aggregate.

Nulls: null html is an empty page and has no declaration; a null address has the empty host.  Documents with a null
language or text teach nothing.  With no labelled documents the language is null.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage
from ._repeats import chunks
from ._vec import LOWER, pack, word_hashes, word_spans
from .toxicity import APART

BUCKETS = 1 << 15
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_ENTITY = re.compile(r"&[a-zA-Z#0-9]+;")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the words' trigrams with their ends, text by text; n + 1 offsets."""
    buf, offs = pack(pa.array(texts, pa.string()))
    starts, ends, before = word_spans(buf := LOWER[buf], offs, APART)
    words = word_hashes(buf, starts, ends)
    n = np.maximum(ends - starts - 2, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else starts, n) + np.arange(int(n.sum()))
    grams = word_hashes(buf, at, at + 3)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    of = np.concatenate([doc, np.repeat(doc, n)])
    h = (np.concatenate([words, grams]) >> np.uint64(30)).astype(np.int64) % BUCKETS
    order = np.argsort(of, kind="stable")
    return h[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


def fit_text(docs: DataFrame, max_documents: int) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(bucket | language) less its mean over languages."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id").orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_documents)
    found: dict[str, np.ndarray] = {}
    for r in docs.select("doc_id", "lang", "text").join(F.broadcast(own), "doc_id").toLocalIterator():
        if r.lang and r.text:  # counted as they come, none is held
            found[r.lang] = found.get(r.lang, 0) + np.bincount(features([r.text])[0], minlength=BUCKETS)
    langs = sorted(found)
    counts = np.stack([0.5 + found[x] for x in langs], 1) if langs else np.zeros((BUCKETS, 0))
    logs = np.log(counts / counts.sum(0)) if langs else counts
    return langs, logs - (logs.mean(1, keepdims=True) if langs else 0)


def _read(pages: DataFrame, langs: list[str], logs: np.ndarray, temper: float) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T, np.float32))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, part in chunks(batch):  # so many bytes at a time
                html = [x or "" for x in part.column(2).to_pylist()]
                h, at = features([_ENTITY.sub(" ", _HIDDEN.sub(" ", x)) for x in html])
                page = np.repeat(np.arange(len(html)), np.diff(at))
                z = np.stack([np.bincount(page, of[h], len(html)) for of in shared.value], 1)
                z = z * temper * np.minimum(1, 60 / np.maximum(np.diff(at), 1) * np.sqrt(np.maximum(np.diff(at), 1) / 60))[:, None]
                e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
                e /= e.sum(1, keepdims=True)
                declared = [m[1].lower() if (m := _DECLARED.search(x)) else None for x in html]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(declared, pa.string()), pa.array(e.tolist(), pa.list_(pa.float64()))], names=["page_id", "url", "declared", "q"])

    return pages.select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text")).mapInArrow(each, "page_id long, url string, declared string, q array<double>")


def _address(url: Column) -> dict[str, Column]:
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    parts = F.split(host, r"\.")
    return {"host": host, "domain": F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), "."), "suffix": F.element_at(parts, -1)}


def identify(pages: DataFrame, docs: DataFrame, max_documents: int = 4_000, temper: float = 0.5, strength: float = 4.0) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and posterior (an array, languages in order of name)."""
    langs, logs = fit_text(docs, max_documents)
    if not langs:
        return pages.select("page_id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"), ("posterior", "array<double>"))])
    n = len(langs)
    read = _read(pages, langs, logs, temper)
    p = stage(read.withColumns(_address(F.col("url"))).withColumn("declared", F.coalesce("declared", F.lit(""))).drop("url"))
    sums = lambda d, name: d.agg(F.array(*[F.sum(F.col("q")[i]) for i in range(n)]).alias(name))
    by_host = sums(p.groupBy("host", "domain", "suffix"), "n_host")
    again = lambda d, old, name: d.agg(F.array(*[F.sum(F.col(old)[i]) for i in range(n)]).alias(name))
    by_domain = again(by_host.groupBy("domain", "suffix"), "n_host", "n_domain")
    by_suffix = again(by_domain.groupBy("suffix"), "n_domain", "n_suffix")
    total = again(by_suffix, "n_suffix", "t").first().t or [0.0] * n
    declared = sums(p.groupBy("declared"), "n_declared")
    kinds = declared.count()
    h = by_host.join(by_domain, ["domain", "suffix"]).join(by_suffix, "suffix").drop("domain", "suffix")
    d = p.join(h, "host").join(declared, "declared")
    plus = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    every = F.array(*[F.lit(float(x)) for x in total])

    def level(counts: Column, above: Column) -> Column:
        left = F.zip_with(counts, F.col("q"), lambda c, q: F.greatest(c - q, F.lit(0.0)))
        return F.zip_with(left, above, lambda c, a: (c + strength * a) / (F.greatest(plus(left), F.lit(0.0)) + strength))

    d = d.withColumn("prior", level(every, F.array(*[F.lit(1.0 / n)] * n)))
    for name in ("n_suffix", "n_domain", "n_host"):
        d = d.withColumn("prior", level(F.col(name), F.col("prior")))
    says = F.zip_with(F.zip_with("n_declared", "q", lambda c, q: F.greatest(c - q, F.lit(0.0)) + 1), every, lambda c, t: c / (t + kinds))
    d = d.withColumn("weight", F.zip_with(F.zip_with("q", "prior", lambda a, b: (a + 1e-9) * b), says, lambda a, b: a * b))
    d = d.withColumn("posterior", F.transform("weight", lambda x: x / plus(F.col("weight"))))
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return d.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), best(F.col("q")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host", "posterior")
