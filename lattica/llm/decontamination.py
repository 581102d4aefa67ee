"""Benchmark decontamination by a positional inverted index, in DataFrame expressions only.

Every window of ``width`` words of a benchmark item (or the whole item, if shorter) is sought in every document.  The
terms of the benchmark are counted over all documents; each window is entered under the terms of its rarest places, one
place more than a proximity match may miss, so that any match agrees in one of them; terms of no document are sure
misses.  Only those terms are indexed.  The index is a table written once: a posting is a document, a position and the hashes
of the words within a window's reach of it, which are what the lists of all other terms hold at these positions.  A posting
moved back by the term's offset in the window gives the one place where the window can start; the window is intersected with
the words around the posting at its offsets.  All of them equal: a phrase match; at least ``near`` of them at their offsets: a
proximity match.  Postings and entries are joined by term, which Spark splits where a term is hot.

The benchmark is the query set.  Its rare terms enter the scan that builds the index as a literal set, ``block`` terms at a
time; any number of blocks is possible, so nothing depends on the benchmark being small.

Nulls: a null or empty text has no words and is hit by nothing; items with a null id still hit words but aren't listed; a null
doc_id is an id like others.  Every row of docs is returned, repeated ones too.  A document of no words is not contaminated;
an empty table of documents gives no rows, an empty benchmark hits nothing.  Very long texts cost memory for their words, once.
Other columns are not looked at, whatever their names.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, let, stage

_APART = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def terms(text: Column) -> Column:
    """Lower-cased words: digits, a to z, and whatever isn't ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + _APART, LOWER + " " * len(_APART)), " "), lambda w: w != "")


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and the words of each distinct window."""
    b = benchmark.select("item_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return b.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.lit(width)).alias("window")).distinct()


def term_frequencies(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Documents that hold each term of the windows; terms of no document are absent."""
    wanted = windows.select(F.explode("window").alias("term")).distinct()
    held = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return held.join(wanted, "term").groupBy("term").agg(F.count("*").alias("df"))


def rarest_terms(windows: DataFrame, frequencies: DataFrame, near: float) -> DataFrame:
    """term, item_id, the term's offset in the window, and the window's words (hashes).  Of the places that suffice, those of
    absent terms are left out; windows with more absent terms than a match may miss go."""
    each = windows.select("item_id", "window", F.posexplode("window").alias("offset", "term")).join(frequencies, "term", "left")
    places = each.groupBy("item_id", "window").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset"))).alias("p"))
    enough = (F.size("window") - F.ceil(F.lit(float(near)) * F.size("window")) + 1).cast("int")
    best = places.select("item_id", "window", F.explode(F.slice("p", F.lit(1), enough)).alias("b")).where(F.col("b.df") > 0)
    return best.select(F.col("b.term").alias("term"), "item_id", F.col("b.offset").alias("offset"), _hashed(F.col("window")).alias("window"))


def _hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def postings(docs: DataFrame, block: list[str], reach: int) -> DataFrame:
    """doc_id, row (hash of the text), n_words, term, pos, around (hashes of the words from reach before to reach after) and
    lead (how many of these stand before): a row for each position of a term of the block, and for each document one with no
    term and pos -1.  Positions are exploded without the text."""
    d = docs.select("doc_id", F.col("text").alias("_text"), terms(F.col("text")).alias("words"))
    kind = "array<struct<term:string,pos:int,around:array<bigint>,lead:int>>"
    mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("pos"), F.lit(None).cast("array<bigint>").alias("around"), F.lit(0).alias("lead"))).cast(kind)
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(block), i)), lambda i: i.isNotNull())
    own = F.transform(at, lambda i: F.struct(F.get("words", i).alias("term"), i.alias("pos"), _hashed(F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))).alias("around"), F.least(i, F.lit(reach)).alias("lead"))).cast(kind)
    d = d.select("doc_id", F.xxhash64("_text").alias("row"), F.size("words").cast("long").alias("n_words"), F.explode(F.concat(mark, own) if block else mark).alias("p"))
    return d.select("doc_id", "row", "n_words", "p.*")


def matches(index: DataFrame, entries: DataFrame, near: float) -> DataFrame:
    """doc_id, row and found: the set of (start, length, item_id, exact) of matches.  A posting moved back by its offset names
    the start; at the other offsets the words around it are those of the lists that hold these positions."""
    p = index.where("pos >= 0").drop("n_words").join(entries, "term")
    n = F.size("window")
    agree = F.size(F.filter(F.transform("window", lambda w, i: F.get("around", F.col("lead") - F.col("offset") + i) == w), lambda x: x))
    p = p.select("doc_id", "row", "item_id", (F.col("pos") - F.col("offset")).alias("start"), n.alias("length"), agree.alias("agree")).where(F.col("agree") >= near * F.col("length"))
    return p.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length", "item_id", (F.col("agree") == F.col("length")).alias("exact"))).alias("found"))


def _covered(spans: Column) -> Column:
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.sort_array(spans), zero,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).cast("int").alias("n"), F.greatest(a["end"], s["start"] + s["length"]).cast("int").alias("end")),
        lambda a: a["n"],
    )


def decontamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, near: float = 0.8, block: int = 20_000, least_share: float = 0.05) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items (ids as sorted strings), n_near and contaminated."""
    windows = stage(item_windows(benchmark, width))
    entries = stage(rarest_terms(windows, term_frequencies(docs, windows), near))
    n_blocks = -(-entries.select("term").distinct().count() // block) or 1
    parts = []
    for b in range(n_blocks):
        own = entries if n_blocks == 1 else entries.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == b)
        part = postings(docs, [r.term for r in own.select("term").distinct().collect()], width - 1)
        parts.append(part if b == 0 else part.where("pos >= 0"))
    index = stage(reduce(DataFrame.unionByName, parts))
    few = entries.count() <= 100_000  # a bounded set of entries is sent to the postings; beyond that both are shuffled by term
    hits = matches(index, F.broadcast(entries) if few else entries, near).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    d = index.where("pos < 0").select("doc_id", "row", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("row").eqNullSafe(F.col("_row")), "left")
    d = d.withColumn("found", F.coalesce("found", F.array().cast(hits.schema["found"].dataType)))
    exact = F.filter("found", lambda m: m["exact"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform(exact, lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull())))
    others = F.array_distinct(F.transform(F.filter("found", lambda m: ~m["exact"]), lambda m: m["item_id"]))
    n_hit = let(F.array_distinct(F.transform(exact, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length")))), _covered)
    d = d.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), items.alias("items"), F.size(others).cast("long").alias("n_near"))
    share = int(round(1 / least_share))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "n_near", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
