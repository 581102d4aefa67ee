"""Metrics over one prediction frame.  Rows of missing truth don't count."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def average_rank(order: Column, *partition: str) -> Column:
    """Ranks from 1; ties share their mean."""
    w = Window.partitionBy(*partition)
    value = order
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


def _by_value(df: DataFrame, keys: list[str], y: str, s: str) -> DataFrame:
    """Rows of equal score as one, so the windows that follow hold distinct scores, not rows."""
    d = df.where(F.col(y).isNotNull() & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")))
    return d.groupBy(*keys, F.col(s).alias("s")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))


def regression(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    d = df.where(F.col(y).isNotNull())
    e = F.col(y) - F.col(p)
    a = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count("*")).alias("sst"))
    return a.select(*keys, "n", "rmse", "mae", (1 - F.col("sse") / F.col("sst")).alias("r2"))


def spearman(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    d = d.withColumn("_ry", average_rank(F.col(y), *keys)).withColumn("_rp", average_rank(F.col(p), *keys))
    return d.groupBy(*keys).agg(F.corr("_ry", "_rp").alias("spearman"))


def auroc(df: DataFrame, keys: list[str], y: str, s: str) -> DataFrame:
    """By ranks, ties count half; NULL with one class only."""
    v = running(_by_value(df, keys, y, s), keys, [F.col("s")], {"below": F.col("n") - F.col("pos")})
    a = v.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)).alias("u"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("m"))
    return a.select(*keys, F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("u") / (F.col("p") * F.col("m"))).alias("auroc"))


def auprc(df: DataFrame, keys: list[str], y: str, s: str) -> DataFrame:
    """Average precision: steps over distinct thresholds."""
    v = running(_by_value(df, keys, y, s), keys, [-F.col("s")], {"_pos": F.col("pos"), "_n": F.col("n")})
    v = v.withColumn("precision", (F.col("_pos") + F.col("pos")) / (F.col("_n") + F.col("n")))
    return v.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("auprc"))


def macro_auroc(df: DataFrame, label: str, y: str, s: str) -> DataFrame:
    """Mean over labels that have both classes."""
    return auroc(df, [label], y, s).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_labels"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("true"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame, y: str, p: str, n_classes: int) -> DataFrame:
    """Precision, recall, F1 and support of classes 0 .. n - 1, empty ones too."""
    c = confusion(df, y, p)
    hit = c.where(F.col("true") == F.col("predicted")).select(F.col("true").alias("class"), F.col("n").alias("hit"))
    t, q = c.groupBy(F.col("true").alias("class")).agg(F.sum("n").alias("support")), c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    d = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    for x in (hit, t, q):
        d = d.join(F.broadcast(x), "class", "left")
    z = lambda k: F.coalesce(F.col(k), F.lit(0)).cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    d = d.select("class", share(z("hit"), z("called")).alias("precision"), share(z("hit"), z("support")).alias("recall"), F.coalesce("support", F.lit(0)).alias("support"), z("called").alias("called"))
    return d.select("class", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support", F.col("called").cast("long").alias("called"))


def balanced(df: DataFrame, y: str, p: str, n_classes: int) -> DataFrame:
    """Mean recall over true classes, and mean F1 over classes of truth or prediction."""
    r = multiclass_report(df, y, p, n_classes)
    return r.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when((F.col("support") > 0) | (F.col("called") > 0), F.col("f1"))).alias("macro_f1"))


def row_normalised(conf: DataFrame) -> DataFrame:
    return conf.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def one_vs_rest(df: DataFrame, y: str, scores: list[str]) -> DataFrame:
    """AUROC of each class's score against the rest; NULL where a class is absent or a score isn't finite."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("class"), (F.col(y) == i).cast("int").alias("hit"), F.col(c).cast("double").alias("s")) for i, c in enumerate(scores)]))
    d = df.where(F.col(y).isNotNull()).select(each.alias("e")).select("e.*")
    bad = d.groupBy("class").agg(F.count_if(F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))).alias("bad"))
    return auroc(d, ["class"], "hit", "s").join(F.broadcast(bad), "class").select("class", F.when(F.col("bad") == 0, F.col("auroc")).alias("auroc"))


def pair_ranking(df: DataFrame, id_: str, partner: str, y: str, p: str) -> DataFrame:
    """Pooled by id; each pair once; true ties are skipped, predicted ones count half."""
    m = df.groupBy(id_, partner).agg(F.avg(y).alias("y"), F.avg(p).alias("p"))
    o = m.select(F.col(id_).alias("_o"), F.col("y").alias("oy"), F.col("p").alias("op"))
    j = m.join(o, F.col(partner) == F.col("_o")).where((F.col(id_) < F.col("_o")) & (F.col("y") != F.col("oy")))
    right = F.when(F.col("p") == F.col("op"), 0.5).when((F.col("p") > F.col("op")) == (F.col("y") > F.col("oy")), 1.0).otherwise(0.0)
    return j.agg(F.avg(right).alias("accuracy"), F.count("*").alias("pairs"))
