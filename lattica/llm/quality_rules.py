"""Quality rules: a learned decision list over per-document statistics, all in DataFrame expressions.

Sequential covering: each rule is a conjunction of thresholds, grown on two thirds of the labelled rows by FOIL gain and
pruned on the rest (last conditions go while precision doesn't fall), kept only if it is precise enough; rows it covers
leave, and the next rule is grown.  The list becomes one ordered CASE expression.  Only the statistics of at most
``max_labelled`` labelled documents (those with the smallest crc32 of their id) reach the driver.

Nulls: a null text has no words.  Null ids or labels in ``labels`` are ignored; a repeated label row counts once, the
largest quality wins.  With no labelled rows the list is empty and the verdict is the base rule's.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Ratios the rules may test.
FEATURES = {
    "symbols_per_word": lambda: F.col("n_symbols") / F.col("n_words"),
    "chars_per_word": lambda: F.col("word_chars") / F.col("n_words"),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.col("n_words"),
    "upper_share": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    "bang_share": lambda: F.col("n_bang") / F.col("n_words"),
    "distinct_share": lambda: F.col("n_distinct") / F.col("n_words"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, is_at_least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, x in self.conditions:
            out = out & ((F.col(name) >= F.lit(x)) if at_least else (F.col(name) < F.lit(x)))
        return out

    def holds(self, row: dict) -> bool:
        return all((row[n] >= x) == at_least for n, at_least, x in self.conditions)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, "\t\x0b\x0c\r ", "")) > 0)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _cover(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: starts sorted by hash find equal neighbours."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(p: Column) -> Column:
        same = F.transform(p, lambda x, j: F.when((x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(pairs, marked), zero,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("int").alias("n"), i.cast("int").alias("last")),
        lambda a: a["n"],
    )


def _repeats(ws: Column) -> Column:
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def count(a: Column) -> Column:
        return F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(_cover(a))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < WINDOW, F.lit(0)).otherwise(let(let(hashed, windows), count))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, n_words and the counts that rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.col("_words")
    d = docs.select("doc_id", *keep, F.col("text").alias("_text"), words(F.col("text")).alias("_words"), _lines(F.col("text")).alias("_lines"))
    text = F.coalesce(F.col("_text"), F.lit(""))
    n = lambda c: c.cast("long")
    return d.select(
        "doc_id", *keep, n(F.size(ws)).alias("n_words"),
        n(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        n(_without(text, SYMBOLS)).alias("n_symbols"),
        n(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        n(_repeats(ws)).alias("n_repeat_words"),
        n(F.size("_lines")).alias("n_lines"), n(F.regexp_count(text, F.lit("\\p{Lu}"))).alias("n_upper"),
        n(_without(text, "!")).alias("n_bang"), n(F.size(F.array_distinct(ws))).alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _precision(rule: Rule, rows: list[dict]) -> float:
    hit = [r["bad"] for r in rows if rule.holds(r)]
    return (sum(hit) + 1) / (len(hit) + 2)


def learn_rules(rows: list[dict], precision: float = 0.95, max_rules: int = 12, max_conditions: int = 3, n_thresholds: int = 32, min_hits: int = 5) -> list[Rule]:
    """Sequential covering over rows of the features, ``bad`` (0 or 1) and ``doc_id``."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    cuts = {}
    for f in FEATURES:  # quantiles of the bad rows and of all rows
        cuts[f] = set()
        for own in (sorted(r[f] for r in rows), sorted(r[f] for r in rows if r["bad"])):
            cuts[f] |= {own[len(own) * k // n_thresholds] for k in range(1, n_thresholds)} if own else set()
    found: list[Rule] = []
    while len(found) < max_rules and sum(r["bad"] for r in grow) >= min_hits:
        conditions: tuple = ()
        inside = grow
        while len(conditions) < max_conditions:
            p0 = sum(r["bad"] for r in inside)
            n0 = len(inside) - p0
            if not n0:
                break
            best = (0.0, None)
            for f in FEATURES:
                own = sorted((r[f], r["bad"]) for r in inside)
                p = k = 0
                for x in sorted(cuts[f]):
                    while k < len(own) and own[k][0] < x:
                        p += own[k][1]
                        k += 1
                    for at_least, a, b in ((False, p, k - p), (True, p0 - p, n0 - (k - p))):
                        if a >= min_hits and (g := _gain(p0, n0, a, b)) > best[0] + 1e-12:
                            best = (g, (f, at_least, x))
            if best[1] is None:
                break
            conditions += (best[1],)
            inside = [r for r in inside if Rule(conditions[-1:]).holds(r)]
        rule = Rule(conditions)
        while len(rule.conditions) > 1 and _precision(Rule(rule.conditions[:-1]), prune) >= _precision(rule, prune):
            rule = Rule(rule.conditions[:-1])
        hits = [r["bad"] for r in rows if rule.holds(r)]
        if not conditions or not hits or sum(hits) < min_hits or sum(hits) < precision * len(hits):
            break
        found.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return found


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[dict]:
    """Features of a bounded sample of labelled documents that the base rule keeps."""
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_labelled)
    )
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"), "quality")
    features = [F.when(F.col("n_words") > 0, f()).alias(k) for k, f in FEATURES.items()]
    got = stats.select("doc_id", (F.col("quality") == 0).cast("int").alias("bad"), *features, base_failed().alias("_failed"))
    # a filter here would be pushed below the statistics and compute them twice
    return [{k: v for k, v in r.asDict().items() if k != "_failed"} for r in got.collect() if not r._failed]


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document: the statistics, base_failed, the number of the rule that rejects it (or null) and kept."""
    rules = learn_rules(labelled_rows(docs, labels, max_labelled), **options)
    d = statistics(docs, *keep).withColumn("base_failed", base_failed()).withColumns({k: f() for k, f in ((k, lambda k=k: F.when(F.col("n_words") > 0, FEATURES[k]())) for k in FEATURES)})
    verdict = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        verdict = F.when(rule.column(), F.lit(i)).otherwise(verdict)
    return d.withColumn("rule", F.when(~F.col("base_failed"), verdict)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
