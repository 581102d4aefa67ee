"""Splits and batches.  Sequential folds run over groups, which are pre-aggregated, never over rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selection import draw_key, smallest_keys


def greedy_fold(groups: DataFrame, group: str, size: str, order: list[Column], train: float, valid: float, inclusive: bool = True) -> DataFrame:
    """Groups, in order, go to train while they fit, else to valid while they fit, else to test; one that overflows is
    passed over, later ones may still fit.  The state is two counts; the fold is one aggregate over the sorted groups."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit_train, limit_valid = train * total, (train + valid) * total
    rows = groups.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(group).alias("g"), F.col(size).cast("double").alias("n")).alias("r"))
    zero = F.expr("named_struct('t', 0D, 'v', 0D, 'out', cast(array() as array<struct<g:string,s:string>>))")
    fits = (lambda a, b: a <= b) if inclusive else (lambda a, b: a < b)

    def put(a: Column, r: Column) -> Column:
        train_ok = fits(a["t"] + r["n"], F.lit(float(limit_train)))
        valid_ok = fits(a["t"] + a["v"] + r["n"], F.lit(float(limit_valid)))
        s = F.when(train_ok, "train").when(valid_ok, "valid").otherwise("test")
        return F.struct((a["t"] + F.when(train_ok, r["n"]).otherwise(0.0)).alias("t"), (a["v"] + F.when(~train_ok & valid_ok, r["n"]).otherwise(0.0)).alias("v"), F.array_append(a["out"], F.struct(r["g"].cast("string").alias("g"), s.alias("s"))).alias("out"))

    folded = rows.agg(F.aggregate(F.array_sort(F.collect_list("r")), zero, put, lambda a: a["out"]).alias("out"))
    return folded.select(F.explode("out").alias("x")).select(F.col("x.g").alias(group), F.col("x.s").alias("split"))


def group_split(df: DataFrame, group: str, pos: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Largest groups first, then by first position."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return greedy_fold(g, group, "n", [-F.col("n"), F.col("first")], train, valid)


def seeded_group_split(df: DataFrame, group: str, seed: int, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Groups over half of valid's target first, each part in seeded order."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    target = (g.agg(F.sum("n")).first()[0] or 0) * valid
    return greedy_fold(g, group, "n", [(F.col("n") <= target / 2).cast("int"), draw_key(seed, 1, group)], train, valid)


def random_split(df: DataFrame, id_: str, seed: int, test: float, valid: float) -> DataFrame:
    """round(f n) rows to test, then to valid, by seeded order; halves round to even."""
    n = df.count()
    n_test, n_valid = round(test * n), round(valid * n)
    key = draw_key(seed, 2, id_)
    last_test, last_valid = (smallest_keys(df.select(id_), key, k) for k in (n_test, n_test + n_valid))
    return df.withColumn("split", F.when(key <= F.lit(last_test), "test").when(key <= F.lit(last_valid), "valid").otherwise("train"))


def any_member_test(df: DataFrame, group: str, split: str) -> DataFrame:
    """A group is test if any member is; straddles if not all are."""
    is_test = F.col(split) == "test"
    return df.groupBy(group).agg(F.bool_or(is_test).alias("test"), (F.bool_or(is_test) & ~F.bool_and(is_test)).alias("straddles"))


def length_batches(df: DataFrame, bucket: Column, id_: str, length: str, budget: int) -> DataFrame:
    """Per bucket: rows by length, cut greedily when the padded size (rows times the longest) would pass the budget; a row
    too long for it is a batch alone.  A bucket is the unit of work, so give it a bounded range of rows."""
    def cut(a: Column, r: Column) -> Column:
        grows = (a["k"] > 0) & ((a["k"] + 1) * r["n"] > budget)
        b = a["b"] + grows.cast("int")
        return F.struct(b.alias("b"), F.when(grows, 1).otherwise(a["k"] + 1).alias("k"), F.array_append(a["out"], F.struct(r["id"].alias("id"), b.alias("b"))).alias("out"))

    zero = F.expr("named_struct('b', 0, 'k', 0, 'out', cast(array() as array<struct<id:bigint,b:int>>))")
    g = df.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("long").alias("n"), F.col(id_).cast("long").alias("id")))).alias("rows"))
    return g.select("bucket", F.explode(F.aggregate("rows", zero, cut, lambda a: a["out"])).alias("x")).select("bucket", F.col("x.id").alias(id_), F.col("x.b").alias("batch"))
