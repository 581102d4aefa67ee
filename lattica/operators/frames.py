"""Frames: ragged structures of one row each, with numbers (elements) and positions (points), by id."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .order import dense_ids


def take(frames: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    """Frames of the ids, each once; an id that has none is an error."""
    wanted = ids.select(id_).distinct()
    missing = wanted.join(frames.select(id_), id_, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no frames for {[r[0] for r in missing]}")
    return frames.join(wanted, id_, "left_semi")


def between(frames: DataFrame, id_: str, start: int, stop: int) -> DataFrame:
    return frames.where((F.col(id_) >= start) & (F.col(id_) < stop))


def concatenate(parts: list[DataFrame], id_: str) -> DataFrame:
    """One after another: ids of a part, 0 to its size, go on where those of the parts before end."""
    out, offset = None, 0
    for p in parts:
        moved = p.withColumn(id_, F.col(id_) + F.lit(offset).cast("long"))
        out = moved if out is None else out.unionByName(moved)
        offset += p.count()
    return out


def with_charges(frames: DataFrame, charges: DataFrame, id_: str) -> DataFrame:
    """Frames and the charges of their ids; a frame without them is an error when its row is read."""
    j = frames.join(charges, id_, "left")
    missing = F.raise_error(F.concat(F.lit("no charge for "), F.col(id_).cast("string")))
    return j.withColumn("total_charge", F.when(F.col("total_charge").isNull(), missing).otherwise(F.col("total_charge")))


def expand(source: DataFrame, structures: DataFrame, charges: DataFrame, id_: str, partner: str, order: list[Column], require_pairs: bool = False) -> tuple[DataFrame, int]:
    """Each source row once for each of its structures, with dense structure_ids in the order given; and the number of orphans.

    Rows without structures go.  A survivor whose partner went is an orphan: its pointer becomes NULL, or with
    ``require_pairs`` it goes too.  A survivor without a charge is an error."""
    there = source.join(structures.select(id_).distinct(), id_, "left_semi")
    partners = there.select(F.col(id_).alias(partner), F.lit(True).alias("_there"))
    known = there.join(partners, partner, "left").withColumn("_orphan", F.col(partner).isNotNull() & F.col("_there").isNull())
    orphans = known.where("_orphan").count()
    if require_pairs:
        known = known.where("NOT _orphan")
    known = known.withColumn(partner, F.when(~F.col("_orphan"), F.col(partner))).drop("_there", "_orphan")
    missing = known.join(charges.select(id_), id_, "left_anti").select(id_).limit(5).collect()
    if missing:
        raise ValueError(f"no charge and multiplicity for {[r[0] for r in missing]}")
    return dense_ids(known.join(structures, id_).join(charges, id_), order, "structure_id"), orphans


def composition(numbers: Column) -> Column:
    """Heavy elements, sorted with their repeats: equal for equal compositions."""
    return F.array_sort(F.filter(numbers, lambda z: z != 1))


def hydrogens(numbers: Column) -> Column:
    return F.size(F.filter(numbers, lambda z: z == 1))


def sole_index(numbers: Column, wanted: Column) -> Column:
    """Place (from 0) of the one element that is wanted; none or several are an error when the row is read."""
    at = F.filter(F.transform(numbers, lambda z, i: F.when(F.array_contains(wanted, z), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) == 1, F.get(at, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("one metal expected, found "), F.size(at).cast("string"))))


def shell_count(numbers: Column, positions: Column, centre: Column, element: int, low: float, high: float) -> Column:
    """Atoms of the element whose distance from the centre is between the two."""
    pairs = F.zip_with(numbers, positions, lambda z, p: F.struct(z.alias("z"), X.distance(p, centre).alias("d")))
    return F.size(F.filter(pairs, lambda x: (x["z"] == element) & (x["d"] > low) & (x["d"] < high)))


def donor_angles(centre: Column, donors: Column) -> Column:
    """Angles in degrees of all pairs of donors at the centre, ascending; a donor on the centre is at 90 to all."""
    def unit(p: Column) -> Column:
        d = X.distance(p, centre)
        scale = F.when(d > 0, d).otherwise(1.0)
        return F.struct(*[((p[c] - centre[c]) / scale).alias(c) for c in "xyz"])

    def all_pairs(u: Column) -> Column:
        dot = lambda a, b: sum((a[c] * b[c] for c in "yz"), a["x"] * b["x"])
        angle = lambda a, b: F.degrees(F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))))
        return F.array_sort(F.flatten(F.transform(u, lambda a, i: F.transform(F.slice(u, i + 2, F.size(u)), lambda b: angle(a, b)))))

    return F.get(F.transform(F.array(F.transform(donors, unit)), all_pairs), F.lit(0))


def geometry_class(angles: Column, cn: Column) -> Column:
    """A coarse name of the coordination geometry, from ascending donor angles and the coordination number."""
    mean = F.aggregate(angles, F.lit(0.0), lambda s, a: s + a) / F.size(angles)
    top = lambda k: F.element_at(angles, -k)
    cis, trans = F.size(F.filter(angles, lambda a: (a > 75) & (a < 105))), F.size(F.filter(angles, lambda a: a > 160))
    return (
        F.when(cn <= 0, "unknown").when(cn == 1, "monocoordinate")
        .when(cn == 2, F.when(F.get(angles, F.lit(0)) > 160, "linear").otherwise("bent"))
        .when(cn == 3, F.when((mean > 110) & (mean < 130), "trigonal_planar").otherwise("T-shape"))
        .when(cn == 4, F.when(mean > 100, "tetrahedral").otherwise("square_planar"))
        .when(cn == 5, F.when((top(1) - top(2)) / 60 > 0.5, "trigonal_bipyramidal").otherwise("square_pyramidal"))
        .when(cn == 6, F.when((cis >= 10) & (trans >= 2), "octahedral_like").otherwise("distorted_6"))
        .otherwise(F.concat(F.lit("high_cn_"), cn.cast("string")))
    )


def sign(x: Column) -> Column:
    """-1, 0 or 1; minus zero is 0."""
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def noisy(positions: Column, level: Column, seed: int, *ids: str) -> Column:
    """Positions with normal noise of the level.  Draws depend on seed, id, atom and axis only, so they are the same on a retry."""
    def draw(i: Column, axis: int) -> Column:
        u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.lit(axis), i, *[F.col(c) for c in ids]), 11).cast("double") + 1) / F.lit(float(2**53 + 1))
        return F.sqrt(-2 * F.ln(u(0))) * F.cos(F.lit(2 * math.pi) * u(1))

    return F.transform(positions, lambda p, i: F.struct(*[(p[c] + level * draw(i, k)).alias(c) for k, c in enumerate("xyz")]))
