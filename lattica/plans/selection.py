"""Selections: chains of steps over a corpus, counted in one pass and returned as sorted ids."""
from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_FLOOR, Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

STEPS: dict[str, Callable] = {}


def step(f: Callable) -> Callable:
    STEPS[f.__name__] = f
    return f


def draw_key(seed: int, stream: int, *ids: str) -> Column:
    """A key in uniform order that depends on seed, stream and id only: draws nest, and rows that go don't move others."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), *[F.col(i).cast("string") for i in ids]).cast("binary"))


def smallest_keys(ids: DataFrame, key: Column, want: int, few: int = 4096) -> str:
    """The want-th smallest of the keys of distinct ids ('' for none), by counts of their prefixes: 4 more characters at a time,
    until the prefix that holds it has few keys."""
    if want <= 0:
        return ""
    d, prefix = ids.select(key.alias("k")), ""
    while True:
        own = d.where(F.col("k").startswith(prefix)) if prefix else d
        counts = own.groupBy(F.substring("k", 1, len(prefix) + 4).alias("p")).count().collect()
        before = 0
        for r in sorted(counts, key=lambda r: r.p):
            if before + r["count"] >= want:
                break
            before += r["count"]
        else:
            raise ValueError(f"fewer than {want} keys")
        prefix, want, found = r.p, want - before, r["count"]
        if found <= few or len(prefix) >= 32:
            return sorted(x.k for x in d.where(F.col("k").startswith(prefix)).collect())[want - 1]


def exact_floor(fraction: float, n: int) -> int:
    return int((Decimal(repr(fraction)) * n).to_integral_value(ROUND_FLOOR))


def overlap_key(smiles: Column, scaffold: Column) -> Column:
    """Scaffold, or the text itself where there is none."""
    return F.when(F.coalesce(scaffold, F.lit("")) != "", F.concat(F.lit("scaffold:"), scaffold)).otherwise(F.concat(F.lit("smiles:"), smiles))


@step
def where(df: DataFrame, condition: str) -> DataFrame:
    try:
        return df.where(condition)
    except AnalysisException as e:
        raise ValueError(f"filter {condition!r}: {e.desc if hasattr(e, 'desc') else e}") from e


@step
def exclude_overlap(df: DataFrame, pool: DataFrame, key: str, group: str) -> DataFrame:
    """Whole groups go if any of their keys is in the pool."""
    hit = df.join(pool.select(key).distinct(), key, "left_semi").select(group).distinct()
    return df.join(hit, group, "left_anti")


@step
def top_k_per_group(df: DataFrame, group: str, rank: str, k: int, minimum: float | None = None, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    d = df.where(F.col(rank).isNotNull())
    d = d.where(F.col(rank) >= minimum) if minimum is not None else d
    w = Window.partitionBy(group).orderBy(F.col(rank).desc() if descending else F.col(rank).asc(), *ties)
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


@step
def random_groups(df: DataFrame, group: str, seed: int, stream: int = 0, count: int | None = None, fraction: float | None = None) -> DataFrame:
    """A seeded draw of whole groups; a count that isn't there is an error.  Groups whose key is no larger than the wanted one's
    are kept by a filter: nothing is sorted or joined."""
    ids, key = stage(df.select(group).distinct()), draw_key(seed, stream, group)
    n = ids.count()
    want = count if count is not None else exact_floor(fraction, n)
    if want > n:
        raise ValueError(f"{want} groups wanted, {n} there")
    return df.where(key <= F.lit(smallest_keys(ids, key, want)))


def turn_times(rank: Column, size: Column, weighting: str, offset: float = 1.0) -> Column:
    weight = {"equal": F.lit(1.0), "sqrt": F.sqrt(size), "size": size.cast("double")}[weighting]
    return (rank + F.lit(offset)) / weight


def hierarchical_order(df: DataFrame, member: str, coarse: str, fine: str, seed: int, weighting: str = "equal") -> DataFrame:
    """Two nested weighted round-robins: members of fine clusters within coarse ones, these within all.  Adds turn."""
    d = df.withColumn("_key", draw_key(seed, 0, member))
    in_fine = Window.partitionBy(coarse, fine)
    d = d.withColumn("_r", F.row_number().over(in_fine.orderBy("_key", member)) - 1).withColumn("_n", F.count("*").over(in_fine))
    d = d.withColumn("_t", turn_times(F.col("_r"), F.col("_n"), weighting))
    in_coarse = Window.partitionBy(coarse)
    d = d.withColumn("_r", F.row_number().over(in_coarse.orderBy("_t", "_key", member)) - 1).withColumn("_n", F.count("*").over(in_coarse))
    return d.withColumn("turn", turn_times(F.col("_r"), F.col("_n"), weighting)).drop("_r", "_n", "_t")


@step
def hierarchical_draw(df: DataFrame, member: str, coarse: str, fine: str, seed: int, count: int, weighting: str = "equal") -> DataFrame:
    d = hierarchical_order(df, member, coarse, fine, seed, weighting)
    return d.orderBy("turn", "_key", member).limit(count).drop("_key", "turn")


def holdout(column: str, fraction: float, seed: int, stream: int = 10) -> Column:
    """Held out iff the id's key is below the fraction; the same in any selection."""
    limit = f"{int(Decimal(repr(fraction)) * 16**13):013x}"
    return F.substring(draw_key(seed, stream, column), 1, 13) < F.lit(limit)


def run(df: DataFrame, steps: list[tuple[str, dict]], group: str) -> tuple[DataFrame, list[dict]]:
    """Apply steps in order; rows and groups left after each."""
    record = []
    for kind, options in steps:
        df = STEPS[kind](df, **options)
        rows, groups = df.agg(F.count("*"), F.countDistinct(group)).first()
        record.append({"step": kind, "rows": rows, "groups": groups})
        if not rows:
            raise ValueError(f"nothing is left after {kind}")
    return df, record
