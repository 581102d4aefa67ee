"""Evaluation cells: a learner fitted on the train part, a tidy row per target scored on the test part; cluster profiles and
linear projections."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import learners as L
from . import metrics as M
from . import stats as ST

#: Metrics that are better when larger.
HIGHER_IS_BETTER = {"rmse": False, "mae": False, "r2": True, "spearman": True, "auroc": True, "auprc": True, "macro_auroc": True, "balanced_accuracy": True, "macro_f1": True, "pair_ranking_accuracy": True}
TASK_METRICS = {"regression": ("rmse", "mae", "r2", "spearman"), "classification": ("auroc", "auprc"), "multilabel": ("macro_auroc",), "multiclass": ("balanced_accuracy", "macro_f1")}


def metrics_with_headline(task: str, headline: str | None = None) -> tuple[str, ...]:
    """A task's metrics, the headline (its first, if none is named) in front."""
    every = TASK_METRICS[task]
    if headline is not None and headline not in every:
        raise ValueError(f"{headline} isn't a metric of {task}")
    return (headline or every[0], *[m for m in every if m != (headline or every[0])])


def class_display_names(n_classes: int, names: tuple[str, ...] | None = None) -> tuple[str, ...]:
    if names is not None and len(names) != n_classes:
        raise ValueError(f"{len(names)} names for {n_classes} classes")
    return tuple(names) if names else tuple(f"class_{i}" for i in range(n_classes))


#: (train rows, feature columns, label) -> a column of predictions.
Learner = Callable[[DataFrame, list[str], str], Column]


def mean_learner(train: DataFrame, x: list[str], y: str) -> Column:
    return F.lit(train.agg(F.avg(y)).first()[0]).cast("double")


def ridge_learner(train: DataFrame, x: list[str], y: str) -> Column:
    return L.linear(x, *L.ridge(train, x, y))


def logistic(train: DataFrame, x: list[str], y: str, c: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Standardised logistic regression of penalty 1 / c by Newton steps; each takes one aggregate of sums, d by d in size.  With
    one class only it is that class's share: a constant."""
    k = len(x)
    d = train.where(F.col(y).isNotNull()).select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(x)], F.col(y).cast("double").alias("y"))
    s = d.agg(F.avg("y").alias("p"), F.count("*").alias("n"), *[F.avg(f"f{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"f{i}").alias(f"s{i}") for i in range(k)]).first()
    mean, std = np.array([s[f"m{i}"] for i in range(k)]), np.array([s[f"s{i}"] or 1.0 for i in range(k)])
    std[std < 1e-12] = 1.0
    if not 0 < s.p < 1:
        return np.zeros(k), 40.0 if s.p else -40.0
    w = np.zeros(k + 1)
    z = [*[(F.col(f"f{i}") - float(mean[i])) / float(std[i]) for i in range(k)], F.lit(1.0)]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((F.lit(float(v)) * c_ for v, c_ in zip(w[1:], z[1:])), F.lit(float(w[0])) * z[0])))
        r = d.select(*[c_.alias(f"z{i}") for i, c_ in enumerate(z)], p.alias("p"), "y")
        a = r.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        penalty = np.append(np.full(k, 1 / c), 0.0)  # none on the intercept
        g = np.array([a[f"g{i}"] for i in range(k + 1)]) + penalty * w
        h = np.array([[a[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    v = w[:k] / std
    return v, float(w[k] - v @ mean)


def logistic_learner(train: DataFrame, x: list[str], y: str) -> Column:
    return 1 / (1 + F.exp(-L.linear(x, *logistic(train, x, y))))


LEARNERS: dict[str, Learner] = {"mean": mean_learner, "ridge": ridge_learner, "logistic": logistic_learner}


def score(predicted: DataFrame, metric: str, y: str, p: str) -> DataFrame:
    """(value, n) over the rows that have a truth."""
    d = predicted.where(F.col(y).isNotNull())
    if metric in ("rmse", "mae", "r2"):
        return M.regression(d, [], y, p).select(F.col(metric).alias("value"), "n")
    one = {"spearman": M.spearman, "auroc": M.auroc, "auprc": M.auprc}[metric](d, [], y, p)
    return one.select(F.col(metric).alias("value")).join(d.agg(F.count("*").alias("n")))


def evaluate_cell(df: DataFrame, x: list[str], targets: list[str], split: str, learner: str, metric: str) -> DataFrame:
    """A row per target: target, learner, metric, value, n_train, n_valid, n_test.  Each target is fitted by itself on the train
    rows that have it, and scored on the test rows that do."""
    out = None
    part = lambda name: F.count_if(F.col(split) == name).alias(f"n_{name}")
    sizes = df.agg(part("train"), part("valid"), part("test"))
    for y in targets:
        train = df.where((F.col(split) == "train") & F.col(y).isNotNull())
        test = df.where(F.col(split) == "test").withColumn("_p", LEARNERS[learner](train, x, y))
        row = score(test, metric, y, "_p").select(F.lit(y).alias("target"), F.lit(learner).alias("learner"), F.lit(metric).alias("metric"), "value").join(sizes)
        out = row if out is None else out.unionByName(row)
    return out


def evaluate_pairwise_cell(df: DataFrame, x: list[str], y: str, split: str, learner: str, id_: str, partner: str) -> DataFrame:
    """One row: how often the larger of a pair is predicted larger, over the pairs whose rows are all in the test part."""
    train = df.where((F.col(split) == "train") & F.col(y).isNotNull())
    test = df.where((F.col(split) == "test") & F.col(y).isNotNull()).withColumn("_p", LEARNERS[learner](train, x, y))
    r = M.pair_ranking(test, id_, partner, y, "_p")
    return r.select(F.lit(y).alias("target"), F.lit(learner).alias("learner"), F.lit("pair_ranking_accuracy").alias("metric"), F.col("accuracy").alias("value"), F.col("pairs").alias("n_test"))


def top_counts(df: DataFrame, cluster: str, column: str, k: int) -> DataFrame:
    """Per cluster the k most frequent values as an array of (value, n); ties by value.  Counted before they are ranked."""
    n = df.where(F.col(column).isNotNull()).groupBy(cluster, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(cluster).orderBy(F.desc("n"), "value")
    top = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))).alias(f"top_{column}"))


def cluster_profiles(df: DataFrame, cluster: str, label: str, means: list[str], shares: list[str], tops: list[str], k: int = 5) -> DataFrame:
    """Per cluster: size, modal label with its share and bits, means, shares of true flags, and the top k values of columns."""
    base = df.groupBy(cluster).agg(F.count("*").alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.avg(F.col(c).cast("int")).alias(f"share_{c}") for c in shares])
    out = base.join(ST.purity(df, cluster, label).select(cluster, "modal", "purity", "bits"), cluster, "left")
    for c in tops:
        out = out.join(top_counts(df, cluster, c, k), cluster, "left")
    return out


def fit_projection(df: DataFrame, vector: str, k: int) -> dict:
    """Mean, deviation (1 where below 1e-8), components and explained shares of the top k principal components of standardised
    vectors, from the d by d covariance alone.  Signs: each component's largest weight is positive."""
    n = df.count()
    if n < 2:
        raise ValueError("two vectors at least")
    means = ST.components_of(df, vector).groupBy("dim").agg(F.avg("x").alias("m"), F.count_if(F.isnan("x") | (F.abs("x") == float("inf")) | F.col("x").isNull()).alias("bad")).orderBy("dim").collect()
    if any(r.bad for r in means):
        raise ValueError("the values are not finite")
    cov = ST.covariance_matrix(ST.covariance(df, vector)) * (n - 1) / n
    if not 0 < k <= min(n, len(cov)):
        raise ValueError(f"cannot keep {k} components of {n} vectors of {len(cov)}")
    std = np.sqrt(np.diag(cov))
    std = np.where(std < 1e-8, 1.0, std)
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    top = vectors[:, :k].T
    top = top * np.sign(top[np.arange(k), np.abs(top).argmax(1)])[:, None]
    return {"mean": [float(r.m) for r in means], "std": std.tolist(), "components": top.tolist(), "explained": (values[:k] / values.sum()).tolist()}


def apply_projection(x: Column, fitted: dict) -> Column:
    return X.project(x, fitted["mean"], fitted["std"], fitted["components"])


def capacity_diagnostic(df: DataFrame, vector: str, drop_above: float | None = None) -> DataFrame:
    """Participation ratio and trace of the vectors after the longest are dropped (above that quantile of norms), centred, scaled
    by sample deviation and brought to unit length."""
    d = df.withColumn("_norm", X.norm(F.col(vector)))
    if drop_above is not None:
        limit = d.approxQuantile("_norm", [drop_above], 0.0)[0]
        d = d.where(F.col("_norm") <= limit)
    s = ST.components_of(d, vector).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).orderBy("dim").collect()
    z = F.zip_with(F.zip_with(vector, F.array(*[F.lit(float(r.m)) for r in s]), lambda a, m: a.cast("double") - m), F.array(*[F.lit(float(r.s) if r.s and r.s > 1e-12 else 1.0) for r in s]), lambda a, v: a / v)
    unit = d.select(z.alias("_z")).select(X.l2_normalize(F.col("_z")).alias("z"))
    return ST.participation_ratio(ST.covariance(unit, "z")).withColumn("n", F.lit(d.count()))


def correlate_cells(panel: DataFrame, capacity: DataFrame, cell: list[str], model: str, score: str, measure: str, distinct: int = 3) -> DataFrame:
    """Spearman of a measure of models with their oriented scores, by cell: only cells that score every model, with so many distinct
    scores at least.  The table of capacity has a row for each model; panels hold a row for each cell and model."""
    whole = panel.groupBy(*cell).agg(F.countDistinct(model).alias("_models"), F.countDistinct(score).alias("_scores"))
    every = capacity.agg(F.countDistinct(model).alias("_all"))
    fit = whole.join(F.broadcast(every)).where((F.col("_models") >= F.col("_all")) & (F.col("_scores") >= distinct)).select(*cell)  # one row is broadcast
    return M.spearman(panel.join(fit, cell).join(capacity.select(model, measure), model), cell, measure, score)


def summary_by_kind(cells: DataFrame, kind: str, value: str) -> DataFrame:
    """Median, mean, share above 0 and count of the values that exist, of all cells ("all") and by kind."""
    d = cells.where(F.col(value).isNotNull() & ~F.isnan(value))
    own = d.select(F.explode(F.array(F.lit("all"), F.concat(F.lit(f"{kind}="), F.col(kind).cast("string")))).alias("group"), F.col(value).alias("_v")).where("group IS NOT NULL")
    return own.groupBy("group").agg(F.median("_v").alias("median"), F.avg("_v").alias("mean"), F.avg((F.col("_v") > 0).cast("double")).alias("share_positive"), F.count("*").alias("n"))
