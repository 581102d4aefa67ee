"""Distributions, spectra and cluster statistics.  All sums are partial-and-final aggregates; only d by d results are collected."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: coverage, n finite, mean, population std, min, max, exact quantiles."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "label", "y").withColumn("v", finite(F.col("y")))
    q = F.percentile("v", F.array(*map(F.lit, QUANTILES)))
    d = long.groupBy("label").agg(F.count("*").alias("total"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q.alias("q"))
    return d.select("label", "n", (F.col("n") / F.col("total")).alias("coverage"), "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{round(100 * x):02d}") for i, x in enumerate(QUANTILES)])


def components_of(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def marginal_entropy(df: DataFrame, vector: str, bins: int) -> DataFrame:
    """Bits of each dimension's histogram of equal-width bins; a constant dimension has none."""
    e = components_of(df, vector)
    ends = e.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = e.join(F.broadcast(ends), "dim").select("dim", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).alias("bin"))
    n = b.groupBy("dim", "bin").count()
    p = n.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("dim")))
    return p.groupBy("dim").agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, c) for i <= j, sample covariance.  Each partition sums its outer products to d (d + 1) / 2 rows before the shuffle."""
    n = df.count()
    means = components_of(df, vector).groupBy("dim").agg(F.avg("x").alias("m")).orderBy("dim").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("a")).first().a
    mean = F.array(*[F.lit(float(r.m)) for r in means])
    d = df.select(F.zip_with(vector, mean, lambda x, m: x.cast("double") - m).alias("z"))
    size = len(means)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += z.T @ z
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    return d.mapInArrow(outer, "i int, j int, s double").groupBy("i", "j").agg((F.sum("s") / (n - 1)).alias("c"))


def vector_problems(df: DataFrame, id_: str, vector: str, size: int) -> DataFrame:
    """Rows, and how many have a wrong size, a component that isn't finite, or an id that was there before."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count("*").alias("rows"), F.count_if(F.size(vector) != size).alias("wrong_size"), F.count_if(bad).alias("not_finite"), (F.count("*") - F.countDistinct(id_)).alias("repeated"))


def participation_ratio(cov: DataFrame) -> DataFrame:
    """(trace C) squared over the squared Frobenius norm: no eigenvalues needed."""
    t = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    f = F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2) * F.col("c") * F.col("c"))
    return cov.agg((t * t / f).alias("participation_ratio"), t.alias("trace"))


def covariance_matrix(cov: DataFrame) -> np.ndarray:
    rows = cov.collect()
    d = 1 + max(r.j for r in rows)
    out = np.zeros((d, d))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.c
    return out


def spectrum(cov: DataFrame) -> list[tuple[int, float, float]]:
    """(rank, eigenvalue, cumulative share), largest first."""
    w = np.clip(np.linalg.eigvalsh(covariance_matrix(cov))[::-1], 0, None)
    return [(i, float(x), float(s)) for i, (x, s) in enumerate(zip(w, np.cumsum(w) / (w.sum() or 1)))]


def coding_rate(cov: DataFrame, eps: float = 0.5) -> float:
    c = covariance_matrix(cov)
    return float(0.5 * np.linalg.slogdet(np.eye(len(c)) + len(c) / eps**2 * c)[1] / np.log(2))


def mean_abs_correlation(cov: DataFrame) -> DataFrame:
    var = cov.where("i = j").select(F.col("i").alias("k"), F.col("c").alias("v"))
    a, b = var.select(F.col("k").alias("i"), F.col("v").alias("vi")), var.select(F.col("k").alias("j"), F.col("v").alias("vj"))
    return cov.where("i < j").join(F.broadcast(a), "i").join(F.broadcast(b), "j").agg(F.avg(F.abs(F.col("c") / F.sqrt(F.col("vi") * F.col("vj")))).alias("mean_abs_correlation"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def mutual_information(table: DataFrame) -> DataFrame:
    """mi and nmi (arithmetic mean of entropies), natural logs, from (a, b, n)."""
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    total = table.agg(F.sum("n").alias("t"))
    d = table.withColumn("na", F.sum("n").over(wa)).withColumn("nb", F.sum("n").over(wb)).join(F.broadcast(total))
    p = lambda c: F.col(c) / F.col("t")
    sums = d.agg(F.sum(p("n") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(-p("n") * F.log(p("na"))).alias("ha"), F.sum(-p("n") * F.log(p("nb"))).alias("hb"))
    return sums.select("mi", (F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def adjusted_mutual_information(table: DataFrame) -> float:
    """Corrected for chance by the hypergeometric expectation; from a contingency table, which is all that is collected."""
    from math import exp, lgamma, log

    rows = table.collect()
    a, b = {}, {}
    for r in rows:
        a[r.a] = a.get(r.a, 0) + r.n
        b[r.b] = b.get(r.b, 0) + r.n
    n = sum(a.values())
    mi = sum(r.n / n * log(r.n * n / (a[r.a] * b[r.b])) for r in rows)
    f = lambda x: lgamma(x + 1)
    expected = sum(k / n * log(n * k / (x * y)) * exp(f(x) + f(y) + f(n - x) + f(n - y) - f(n) - f(k) - f(x - k) - f(y - k) - f(n - x - y + k)) for x in a.values() for y in b.values() for k in range(max(1, x + y - n), min(x, y) + 1))
    ha, hb = (-sum(x / n * log(x / n) for x in c.values()) for c in (a, b))
    top = (ha + hb) / 2 - expected
    return (mi - expected) / top if abs(top) > 1e-15 else 1.0


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: members (all), resolved ones, modal label, its share of the resolved, Shannon bits."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(cluster)
    known = n.where(F.col(label).isNotNull()).withColumn("p", F.col("n") / F.sum("n").over(w))
    out = known.groupBy(cluster).agg(F.sum("n").alias("resolved"), F.max_by(label, F.struct("n", F.hash(F.lit(0)), label)).alias("modal"), F.max("p").alias("purity"), F.sum(-F.col("p") * F.log2("p")).alias("bits"))
    return n.groupBy(cluster).agg(F.sum("n").alias("members")).join(out, cluster, "left")


def weighted_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return purity(df, cluster, label).where("purity IS NOT NULL").agg((F.sum(F.col("members") * F.col("purity")) / F.sum("members")).alias("purity"))


def pairwise_jaccard(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """Of the key sets of all pairs of datasets."""
    d = df.where(F.col(key).isNotNull()).select(F.col(dataset).alias("a"), F.col(key).alias("k")).distinct()
    size = d.groupBy("a").agg(F.count("*").alias("n"))
    both = d.join(d.select(F.col("a").alias("b"), "k"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    names = size.select(F.col("a"), F.col("n").alias("na")).join(size.select(F.col("a").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    j = names.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return j.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def isim(df: DataFrame, bits: str, n_bits: int) -> DataFrame:
    """Mean pair similarity from column sums: no pairs are made."""
    n = df.count()
    k = df.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count("*").cast("double").alias("k"))
    both = F.col("k") * (F.col("k") - 1) / 2
    return k.agg((F.sum(both) / F.sum(both + F.col("k") * (n - F.col("k")))).alias("isim"))


def pooled(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector by group."""
    e = components_of(df, vector, group).groupBy(group, "dim").agg(F.avg("x").alias("m"))
    return e.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
