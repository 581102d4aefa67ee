"""Exact linear fits from sums, and thin wrappers of MLlib."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_learner(train: DataFrame, y: str, keys: list[str] | None = None) -> DataFrame:
    return train.where(F.col(y).isNotNull()).groupBy(*(keys or [])).agg(F.avg(y).alias("prediction"))


def ridge(train: DataFrame, x: list[str], y: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Standardised (population) ridge by normal equations: one aggregate of sums, a d by d solve on the driver."""
    d = train.where(F.col(y).isNotNull())
    for c in x:
        d = d.where(F.col(c).isNotNull())
    cols = [*x, y]
    sums = d.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    k = len(x)
    c = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    std = np.sqrt(np.diag(c)[:k])
    std[std < 1e-12] = 1.0
    z = c[:k, :k] / np.outer(std, std)
    w = np.linalg.solve(sums.n * z + alpha * np.eye(k), sums.n * c[:k, k] / std) / std
    return w, float(sums[f"m{k}"] - sum(w[i] * sums[f"m{i}"] for i in range(k)))


def linear(x: list[str], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, v in zip(x, w):
        out = out + F.lit(float(v)) * F.col(c)
    return out


def class_weights(df: DataFrame, y: str, n_classes: int) -> DataFrame:
    """N / (C count), absent classes 1, then scaled to mean 1."""
    n = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    d = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class")).join(n, "class", "left").join(F.broadcast(total))
    raw = d.select("class", F.coalesce(F.col("t") / (n_classes * F.col("n")), F.lit(1.0)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("m"))
    return raw.join(F.broadcast(mean)).select("class", (F.col("raw") / F.col("m")).alias("weight"))


def gbt(train: DataFrame, x: list[str], y: str, kind: str = "regression", **options):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    d = VectorAssembler(inputCols=x, outputCol="features", handleInvalid="skip").transform(train.where(F.col(y).isNotNull()))
    return (GBTRegressor if kind == "regression" else GBTClassifier)(labelCol=y, featuresCol="features", **options).fit(d)


def near_pairs(vectors: DataFrame, id_: str, group: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """Pairs (a, b), both ways, of vectors of one group and size whose cosine is ``least`` or more.  Groups are dealt into blocks of
    ``block`` vectors or so, and each pair of blocks is one matrix product; cosines close to ``least`` are summed again in
    order.  Vectors that are null, hold nulls, or have no length are near none."""
    own = vectors.where(F.col(group).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.col(id_).alias("id"), F.col(group).alias("g"), F.size(vector).alias("d"), F.col(vector).alias("v"))
    blocks = own.groupBy("g", "d").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    own = own.join(blocks, ["g", "d"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))

    def cosine(x: np.ndarray, y: np.ndarray) -> float:
        dot = lambda a, b: float(np.cumsum(a * b)[-1])  # noqa: E731  in order, as the SQL expression
        return dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5)

    def each(rows: pa.Table) -> pa.Table:
        v = rows.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        i, of, lo, hi = (rows.column(c).to_numpy() for c in ("id", "own", "lo", "hi"))
        with np.errstate(all="ignore"):
            unit = x / np.sqrt((x * x).sum(1))[:, None] if x.shape[1] else np.full((len(x), 1), np.nan)
        left, right = np.flatnonzero(of == lo), np.flatnonzero(of == hi)
        s = unit[left] @ unit[right].T
        for q, r in np.argwhere(np.abs(s - least) < 1e-9).tolist():
            s[q, r] = cosine(x[left[q]], x[right[r]])
        q, r = np.nonzero(s >= least)
        a, b = i[left[q]], i[right[r]]
        a, b = (a[a != b], b[a != b]) if lo[0] == hi[0] else (np.concatenate([a, b]), np.concatenate([b, a]))
        return pa.table({"a": a, "b": b})

    kind = dict(vectors.dtypes)[id_]
    return own.select("id", "v", "own", "g", "d", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).groupBy("g", "d", "lo", "hi").applyInArrow(each, f"a {kind}, b {kind}")


def leader_clusters(pairs: DataFrame, ids: DataFrame, id_: str, weight: str | None = None) -> DataFrame:
    """Butina from neighbour pairs (a, b), both ways: in rounds, every id that has the most open neighbours among itself
    and its open neighbours' neighbours leads; it and its neighbours leave.  Ties go to the smaller id.  An id may stand for
    ``weight`` alike ones, which are neighbours of one another.  Pairs are written once, and then those still open."""
    from ..storage import stage

    open_ = stage(ids.select(id_, (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")))
    weights = open_.select(F.col(id_).alias("b"), "w")
    live = stage(pairs.select("a", "b"))
    out = None
    while not open_.isEmpty():
        n = live.join(weights, "b").groupBy("a").agg(F.sum("w").alias("n"))
        deg = open_.withColumnRenamed(id_, "a").join(n, "a", "left").select("a", F.struct((F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), (-F.col("a")).alias("o")).alias("rank"))
        deg = stage(deg)
        near = stage(live.join(deg.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max("rank").alias("best")))
        far = live.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max("best").alias("best2"))
        lead = stage(deg.join(near, "a", "left").join(far, "a", "left").where((F.col("rank") >= F.coalesce("best", "rank")) & (F.col("rank") >= F.coalesce("best2", "rank"))).select("a"))
        took = stage(lead.select(F.col("a").alias("leader"), F.col("a").alias(id_)).unionByName(live.join(lead, "a").select(F.col("a").alias("leader"), F.col("b").alias(id_))))
        out = took if out is None else out.unionByName(took)
        open_ = stage(open_.join(took.select(id_), id_, "left_anti"))
        live = stage(live.join(took.select(F.col(id_).alias("a")), "a", "left_anti").join(took.select(F.col(id_).alias("b")), "b", "left_anti").select("a", "b"))
    return ids.select(F.lit(None).cast(dict(ids.dtypes)[id_]).alias("leader"), id_).limit(0) if out is None else out
