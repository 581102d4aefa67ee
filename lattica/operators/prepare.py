"""Replicates, accounting, reasons, identity and invariants of prepared tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dense_ids


def first_seen_ids(df: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """Dense ids in order of first occurrence.  Only distinct keys are put in order, by ranges."""
    first = df.groupBy(key).agg(F.min(pos).alias("_first"))
    return df.join(dense_ids(first, [F.col("_first")], name).drop("_first"), key)


def majority_vote(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, vote (NULL if the two top values tie) and tied; missing values don't vote."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    top = n.groupBy(key).agg(F.max("_n").alias("_top"))
    best = n.join(top, key).where(F.col("_n") == F.col("_top")).groupBy(key).agg(F.count("*").alias("_k"), F.min(value).alias("_v"))
    return best.select(key, F.when(F.col("_k") == 1, F.col("_v")).alias("vote"), (F.col("_k") > 1).alias("tied"))


def merge_replicates(df: DataFrame, key: str, pos: str, regression: list[str], classes: list[str]) -> DataFrame:
    """A row per key in first-seen order (column first): means of regression labels, votes of classes, n rows."""
    out = df.groupBy(key).agg(F.min(pos).alias("first"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in regression])
    for c in classes:
        out = out.join(majority_vote(df, key, c).select(key, F.col("vote").alias(c), F.coalesce("tied", F.lit(False)).alias(f"{c}_tied")), key, "left")
    return out


def account(df: DataFrame, reason: str) -> DataFrame:
    """Rows by reason; kept is the absence of one.  The counts add up to the source's rows by construction."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def reasons_by_run(df: DataFrame, run: str, reason: str, reasons: list[str]) -> DataFrame:
    """A row per run: rows kept, and those of each reason, 0 where a run has none."""
    p = df.groupBy(run).pivot(reason, reasons).count()
    kept = df.groupBy(run).agg(F.count_if(F.col(reason).isNull()).alias("kept"))
    return kept.join(p, run).select(run, "kept", *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in reasons])


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def collapse_entries(df: DataFrame, key: str, pos: str, label: str) -> DataFrame:
    """First row's label by key, the distinct labels, and whether both signs occur."""
    return df.groupBy(key).agg(F.min_by(label, pos).alias("label"), F.array_sort(F.collect_set(label)).alias("labels"), (F.max(F.signum(label)) * F.min(F.signum(label)) < 0).alias("opposite"))


def provenance(df: DataFrame, labels: list[str], split: str) -> DataFrame:
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in labels])
    flat = counts.unpivot([], ["rows", *labels], "item", "n")
    return flat.unionByName(df.groupBy(F.concat(F.lit("split:"), F.col(split)).alias("item")).agg(F.count("*").alias("n")))


def mirror_pairs(df: DataFrame, id_: str, form: str, mirror: str) -> DataFrame:
    """Adds enantiomer_of: the row whose form is this one's mirror and the other way round; a self-mirror has none."""
    other = df.select(F.col(id_).alias("_partner"), F.col(form).alias("_f"), F.col(mirror).alias("_m"))
    j = df.join(other, (F.col(mirror) == F.col("_f")) & (F.col("_m") == F.col(form)) & (F.col(form) != F.col(mirror)), "left")
    return j.select(*df.columns, F.col("_partner").alias("enantiomer_of"))


def enantiomer_problems(df: DataFrame, id_: str, partner: str, molecule: str) -> DataFrame:
    """Rows whose partner is absent, doesn't point back, is itself, or belongs to another molecule."""
    other = df.select(F.col(id_).alias("_p"), F.col(partner).alias("_back"), F.col(molecule).alias("_mol"), F.lit(True).alias("_there"))
    j = df.where(F.col(partner).isNotNull()).join(other, F.col(partner) == F.col("_p"), "left")
    problem = F.when(F.col(partner) == F.col(id_), "self").when(F.col("_there").isNull(), "absent").when(~F.col("_back").eqNullSafe(F.col(id_)), "asymmetric").when(F.col("_mol") != F.col(molecule), "other_molecule")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select(id_, "problem")


def straddling(df: DataFrame, group: str, child: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(child).alias("children"), F.countDistinct(split).alias("splits")).where("children > 1 AND splits > 1")


def violations(df: DataFrame, checks: dict[str, tuple[Column, str]], limit: int = 5) -> DataFrame:
    """One pass over the rows: each check's number of violations and its first keys (at most limit, a report's)."""
    each = F.filter(F.array(*[F.when(bad, F.struct(F.lit(name).alias("invariant"), F.col(key).cast("string").alias("key"))) for name, (bad, key) in checks.items()]), lambda x: x.isNotNull())
    rows = df.select(F.explode(each).alias("v")).select("v.*")
    w = Window.partitionBy("invariant").orderBy("key")
    few = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).groupBy("invariant").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("first_keys"))
    return rows.groupBy("invariant").agg(F.count("*").alias("n")).join(few, "invariant")


def cluster_problems(df: DataFrame, id_: str, coarse: str, fine: str) -> DataFrame:
    nulls = df.agg(F.lit("null").alias("problem"), F.count_if(F.col(id_).isNull() | F.col(coarse).isNull() | F.col(fine).isNull()).alias("n"))
    twice = df.groupBy(id_).count().where("count > 1").agg(F.lit("duplicate").alias("problem"), F.count("*").alias("n"))
    spans = df.groupBy(fine).agg(F.countDistinct(coarse).alias("k")).where("k > 1").agg(F.lit("fine_in_two_coarse").alias("problem"), F.count("*").alias("n"))
    return nulls.unionByName(twice).unionByName(spans)


def drop_orphans(df: DataFrame, id_: str, partner: str, require: bool) -> DataFrame:
    """After rows went: partners that are gone become NULL, or their rows go too."""
    there = df.select(F.col(id_).alias(partner), F.lit(True).alias("_there"))
    j = df.join(there, partner, "left")
    if require:
        return j.where(F.col(partner).isNull() | F.col("_there")).drop("_there").select(df.columns)
    return j.withColumn(partner, F.when(F.col("_there"), F.col(partner))).drop("_there").select(df.columns)


def match_multiset(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th copy of a content on the left takes the k-th on the right."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b = (d.withColumn("_k", F.row_number().over(w)) for d in (left, right))
    return a.join(b.withColumnRenamed(order, f"matched_{order}"), [*keys, "_k"], "left").drop("_k")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return o.join(n, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def dedupe_components(df: DataFrame, content: str, ordinal: str) -> DataFrame:
    """The earliest component that has a content keeps it, with its repeats; missing contents stay."""
    known = df.where(F.col(content).isNotNull())
    first = known.groupBy(content).agg(F.min(ordinal).alias(ordinal))
    return known.join(first, [content, ordinal], "left_semi").select(df.columns).unionByName(df.where(F.col(content).isNull()))


def cover_problems(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, or more than once."""
    a, b = ids.groupBy(key).agg(F.count("*").alias("_a")), vectors.groupBy(key).agg(F.count("*").alias("_b"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated").alias("problem")).where("problem IS NOT NULL")
