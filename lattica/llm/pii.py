"""PII: base patterns plus spans found by weak supervision, in DataFrame expressions only.

Base kinds are patterns with checks.  For what they miss (keys, passwords, account numbers) long tokens with a digit
are candidates, on which labelers vote yes, no or nothing: formats (regex), key prefixes and names of secrets (gazetteer),
words before the token (context), and mixtures of characters.  Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability and each pattern's posterior; a logistic classifier over votes and shape is trained
on these posteriors and becomes one column expression.  Vote patterns are at most 3**6 times 12 shapes, whatever the
corpus, so only such counts reach the driver.

Nulls: a null text is empty and has no spans.  Every row is scored by itself, repeated ones and those of a null id too; an
empty table gives no rows.  A very long text is one row's work, in time that grows with its length and, but for a logarithm,
its matches.  Columns of docs that aren't asked for by ``keep`` are not looked at, whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))"
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+"
KINDS = ("email", "ip", "card", "phone", "secret", "account")


def running(values: Column, both, none: int = 0) -> Column:
    """both(...both(both(v0, v1), v2)..., vi) at each place i, for sums and maxima of integers (none: what changes nothing).  In
    as many passes as n has binary digits, each of which takes in twice the places before: no work grows with n squared."""
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, values, lambda a, by: F.transform(a, lambda v, i: both(v, F.when(i >= by, F.get(a, i - by)).otherwise(none))))


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(text: Column, pattern: str, before: int = 0) -> Column:
    """Non-overlapping matches from the left: structs of start, end (code points), the string m, and, if asked for, up to so
    many characters in front of it (those at least that stand after the match before the last)."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        size = F.transform(both["h"], lambda h, i: F.length(h) + F.length(F.get(both["p"], i)))

        def one(h: Column, i: Column, ends: Column) -> Column:
            end = F.get(ends, i)
            told = [(end - F.length(h)).alias("start"), end.alias("end"), h.alias("m")]
            if before:
                lead = [F.when(i >= k, F.get(both[c], i - k)).otherwise("") for k, c in ((2, "h"), (1, "p"), (1, "h"), (0, "p"))]
                told.append(F.right(F.concat(*lead), F.lit(before)).alias("before"))
            return F.struct(*told)

        return let(running(size, lambda a, b: a + b), lambda ends: F.transform(both["h"], lambda h, i: one(h, i, ends)))

    return let(F.struct(parts.alias("p"), hits.alias("h")), placed)


def _apart(found: Column, base: Column) -> Column:
    """Those of found (in order, none overlapping another) that overlap none of base (in order): neither a base span that
    starts before one ends later than its start, nor one that starts later begins before its end."""
    def sifted(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(s["i"] < 0, s["end"]).otherwise(-1))
        later = F.reverse(F.transform(every, lambda s: F.when(s["i"] < 0, -s["start"]).otherwise(-(1 << 30))))
        over = F.struct(running(ends, _max, -1).alias("left"), F.reverse(running(later, _max, -(1 << 30))).alias("right"))
        free = let(over, lambda o: F.transform(every, lambda s, k: F.when((s["i"] >= 0) & (F.get(o["left"], k) <= s["start"]) & (-F.get(o["right"], k) >= s["end"]), s["i"])))
        return F.transform(F.filter(free, lambda i: i.isNotNull()), lambda i: F.get(found, i))

    own = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    its = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("i")))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(F.sort_array(F.concat(own, its)), sifted))
def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(F.filter(each, lambda c: c != ""), lambda c, i: (c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))), F.lit(0), lambda a, x: (a + F.when(x > 9, x - 9).otherwise(x)).cast("int"))
    return total % 10 == 0


def _kind(name: str, text: Column, quick: Column, pattern: str, passes) -> Column:
    kept = F.filter(located(text, pattern), lambda s: passes(s["m"]))
    order = F.lit(KINDS.index(name))
    tagged = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), order.alias("kind"), s["end"].alias("end")))
    return F.when(quick, tagged).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    ip_ok = f"^{BYTE}\\.{BYTE}\\.{BYTE}\\.{BYTE}$"
    size = lambda m: F.length(_digits(m))
    return {
        "email": _kind("email", text, text.contains("@"), EMAIL, lambda m: F.lit(True)),
        "ip": _kind("ip", text, digit & text.contains("."), IP, lambda m: m.rlike(ip_ok)),
        "card": _kind("card", text, digit, CARD, lambda m: let(_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d))),
        "phone": _kind("phone", text, text.contains("+"), PHONE, lambda m: size(m).between(9, 15)),
    }


# --- weak supervision -------------------------------------------------------------------------------------------------

_ALL_DIGITS = "^[0-9]+$"


def _votes(m: Column, before: Column) -> dict[str, Column]:
    """1 yes, -1 no, 0 nothing, by labeler; before: the characters in front of the token."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    words_only = "^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$"
    named = "(?i)^(?:password|passwd|pwd|secret|token|api_?key|auth|key)=.{6,}$"
    context = "(?i)(?:password|passwd|secret|token|key|bearer|auth|account|iban|card)[\"']?\\s*[:=]?\\s*[\"']?$"
    hexa = m.rlike("^[0-9a-f]{16,}$") & m.rlike("[a-f]")
    figures = F.length(_digits(m)) / F.length(m)
    return {
        "format": F.when(m.rlike("^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|[sp]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abprs]-.{10,}|eyJ.{20,})$"), yes).when(m.rlike(words_only), no).otherwise(none),
        "named": F.when(m.rlike(named), yes).when(m.rlike("^[A-Za-z0-9]+=?$"), none).otherwise(no),
        "context": F.when(before.rlike(context), yes).otherwise(none),
        "mixed": F.when(figures.between(0.12, 0.9) & (F.length(m) >= 16), yes).when(figures < 0.08, no).otherwise(none),
        "hex": F.when(hexa, yes).when(m.rlike("[g-z]{6,}") & ~m.rlike(named), no).otherwise(none),
        "figures": F.when(m.rlike(_ALL_DIGITS) | m.rlike("^[0-9]{1,4}(?:[-/][0-9]{1,4}){2,}"), no).otherwise(none),
    }


LABELERS = ("format", "named", "context", "mixed", "hex", "figures")


def _shape(m: Column) -> Column:
    """Length in three classes, and all digits, lower case, upper case or mixed."""
    length = F.when(F.length(m) < 16, 0).when(F.length(m) < 24, 1).otherwise(2)
    chars = F.when(m.rlike(_ALL_DIGITS), 0).when(~m.rlike("[A-Z]"), 1).when(~m.rlike("[a-z]"), 2).otherwise(3)
    return length * 4 + chars


def candidates(text: Column, base: Column) -> Column:
    """Structs of start, end, digits (all are), shape and a vote by each labeler; none overlaps a base span."""
    def voted(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].rlike(_ALL_DIGITS).alias("digits"), _shape(s["m"]).alias("shape"), *[v.cast("int").alias(k) for k, v in _votes(s["m"], s["before"]).items()])

    free = let(located(text, CANDIDATE, 24), lambda found: _apart(found, base))
    kind = "array<struct<start:int,end:int,digits:boolean,shape:int," + ",".join(f"{k}:int" for k in LABELERS) + ">>"
    return F.when(text.rlike("[0-9]"), F.transform(free, voted)).otherwise(F.array()).cast(kind)


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[dict, list[tuple[float, float]], float]:
    """EM for a two-class model in which labelers vote independently given the class and may abstain.

    Returns the posterior of each vote pattern, each labeler's (P(yes | private, voted), P(yes | not, voted)), and the
    prior.  It starts from the sign of the votes' sum."""
    total = sum(n for _, n in patterns) or 1.0
    post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns}
    rates: list[tuple[float, float]] = []
    prior = 0.5
    for _ in range(rounds):
        prior = min(max(sum(n * post[v] for v, n in patterns) / total, 0.01), 0.5)  # no vote, no reason
        rates = []
        for k in range(len(LABELERS)):
            def rate(weight, k=k):
                yes = sum(n * weight(v) for v, n in patterns if v[k] > 0)
                voted = sum(n * weight(v) for v, n in patterns if v[k])
                return yes, voted
            (y1, t1), (y0, t0) = rate(lambda v: post[v]), rate(lambda v: 1 - post[v])
            # labelers are better than chance: the prior counts say so
            rates.append((min(max((y1 + 8) / (t1 + 10), 0.5), 0.999), min(max((y0 + 2) / (t0 + 10), 0.001), 0.5)))
        for v, _ in patterns:
            z = math.log(prior / (1 - prior))
            for x, (a, b) in zip(v, rates):
                z += math.log(a / b) if x > 0 else math.log((1 - a) / (1 - b)) if x < 0 else 0.0
            post[v] = 1 / (1 + math.exp(-max(min(z, 30), -30)))
    return post, rates, prior


def _features(votes: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *[float(x > 0) for x in votes], *[float(x < 0) for x in votes], *[float(shape // 4 == i) for i in (1, 2)], *[float(shape % 4 == i) for i in (1, 2, 3)]]


def train(counts: list[tuple[tuple[int, ...], int, float]], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic weights over _features, fitted to the posteriors."""
    merged: dict = {}
    for v, _, n in counts:
        merged[v] = merged.get(v, 0.0) + n
    post, _, _ = estimate(list(merged.items()))
    rows = [(_features(v, s), post[v], math.log1p(n)) for v, s, n in counts]
    w = [0.0] * len(_features((0,) * len(LABELERS), 0))
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g = [0.001 * x for x in w]
        for x, y, n in rows:
            e = n / total * (1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(w, x)), 30), -30))) - y)
            for i, xi in enumerate(x):
                if xi:
                    g[i] += e * xi
        w = [a - 8 * rate * b for a, b in zip(w, g)]
    return w


def _with_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, _text, the four base arrays, _base (all, sorted) and _found (candidates)."""
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    d = d.select("doc_id", *keep, "_text", *[c.alias(k) for k, c in base_spans(F.col("_text")).items()])
    d = d.withColumn("_base", F.sort_array(F.concat("email", "ip", "card", "phone")))
    return d.withColumn("_found", candidates(F.col("_text"), F.col("_base")))


def fit(docs: DataFrame) -> list[float]:
    """Weights of the span classifier from the votes of all candidates of all documents."""
    c = _with_spans(docs).select(F.explode("_found").alias("c")).select("c.*").groupBy(*LABELERS, "shape").count()
    return train([(tuple(r[k] for k in LABELERS), r["shape"], float(r["count"])) for r in c.collect()])


def _score(c: Column, w: list[float]) -> Column:
    z, n = F.lit(w[0]), len(LABELERS)
    for i, k in enumerate(LABELERS):
        z = z + F.when(c[k] > 0, F.lit(w[1 + i])).when(c[k] < 0, F.lit(w[1 + n + i])).otherwise(F.lit(0.0))
    z = z + F.when(F.floor(c["shape"] / 4) == 1, F.lit(w[1 + 2 * n])).when(F.floor(c["shape"] / 4) == 2, F.lit(w[2 + 2 * n])).otherwise(F.lit(0.0))
    return z + F.element_at(F.array(F.lit(0.0), *[F.lit(x) for x in w[3 + 2 * n:]]), (c["shape"] % 4 + 1).cast("int"))


def find_private(docs: DataFrame, weights: list[float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the base arrays, base and spans: arrays of (start, kind as a number of KINDS, end), sorted."""
    weights = fit(docs) if weights is None else weights
    d = _with_spans(docs, *keep)
    more = F.filter("_found", lambda c: _score(c, weights) > 0)
    extra = F.transform(more, lambda c: F.struct(c["start"].alias("start"), F.when(c["digits"], KINDS.index("account")).otherwise(KINDS.index("secret")).alias("kind"), c["end"].alias("end")))
    return d.select("doc_id", *keep, F.col("_text").alias("text"), "email", "ip", "card", "phone", F.col("_base").alias("base"), F.sort_array(F.concat("_base", extra)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one, of the first's kind) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(x: Column) -> Column:  # x: the characters, and up to where spans reach
        done = lambda i: F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
        slices = F.transform(spans, lambda s, i: F.when(s["start"] >= done(i), F.concat(F.array_join(F.slice(x["c"], done(i) + 1, s["start"] - done(i)), ""), F.element_at(names, s["kind"] + 1))))
        tail = F.slice(x["c"], F.element_at(x["reach"], -1) + 1, F.size(x["c"]))
        return F.concat(F.array_join(slices, ""), F.array_join(tail, ""))

    ends = running(F.transform(spans, lambda s: s["end"]), _max)
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(F.split(text, "").alias("c"), ends.alias("reach")), cut))
