"""Global order without one task for all rows: range partitions, their totals, and offsets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of the sums, its total over the rows of the same keys that stand before, in the order given.

    Rows are dealt by ranges of keys and order and written once; windows are within a range, and what the ranges before it hold
    is added from a table of one row per range and key."""
    names = [f"_o{i}" for i in range(len(order))]
    d = df.withColumns(dict(zip(names, order)))
    d = stage(d.repartitionByRange(*[F.col(k) for k in keys], *[F.col(n) for n in names]).withColumn("_range", F.spark_partition_id()))
    part = d.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    own = Window.partitionBy("_range", *keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_s{i}": F.coalesce(F.sum(c).over(own), F.lit(0)) for i, c in enumerate(sums.values())})
    on = F.col("_range") == F.col("_r")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    out = d.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(sums)])


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order given, which should have no ties."""
    return running(df, [], order, {name: F.lit(1).cast("long")})
