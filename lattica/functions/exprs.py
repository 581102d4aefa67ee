"""Column expressions: similarity, bases, schedules, chemistry-table lookups, rule cascades."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tanimoto(a: Column, b: Column) -> Column:
    """Of packed bit words; two empty sets are alike."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + F.bit_count(v))
    both, either = total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))), total(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def word_bits(text: Column, words: int = 64) -> Column:
    """A stand-in fingerprint of a whole text: its hashed words as 64-bit words.  Bits come from md5, so SQL can repeat them."""
    bits = F.array_distinct(F.transform(F.array_distinct(F.split(text, " ")), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % (words * 64)))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(one(b))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def bessel(d: Column, n: int, cutoff: float) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lit(math.sqrt(2 / cutoff)) * F.sin(k * F.lit(math.pi) * d / cutoff) / d)


def gaussian(d: Column, centres: list[float], width: float) -> Column:
    return F.transform(F.array(*map(F.lit, centres)), lambda m: F.exp(-0.5 * F.pow((d - m) / width, 2)))


def pad_length(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def warm_up_then_decay(step: Column, warm_up: int, total: int, floor: float = 0.0) -> Column:
    """Linear up to 1, then a cosine down to the floor."""
    done = F.least(F.greatest((step - warm_up) / F.lit(max(total - warm_up, 1)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm_up, (step + 1) / F.lit(warm_up)).otherwise(F.lit(floor) + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))


def element_block(z: Column) -> Column:
    """Rows of the d and f blocks: 3d, 4d, 5d, 4f, 5f; else main."""
    return F.when(z.between(21, 30), "3d").when(z.between(39, 48), "4d").when(z.between(57, 71), "4f").when(z.between(72, 80), "5d").when(z.between(89, 103), "5f").otherwise("main")


def size_band(n: Column) -> Column:
    return F.when(n < 25, "small").when(n < 60, "medium").otherwise("large")


def donor_counts(text: Column) -> Column:
    """'N2O4' to a map of symbol and count."""
    pattern = F.lit("([A-Z][a-z]?)(\\d+)")
    return F.map_from_arrays(F.regexp_extract_all(text, pattern, F.lit(1)), F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: x.cast("int")))


def donor_signature(counts: Column) -> Column:
    """Carbon first, then by symbol."""
    ordered = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((e["key"] != "C").alias("o"), e["key"].alias("k"), e["value"].alias("n"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["k"], e["n"].cast("string"))), "")


def z_score(x: Column, mean: Column, std: Column, eps: float = 1e-12) -> Column:
    """Of arrays; std is the population's."""
    return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda a, s: a / (s + eps))


def l2_normalize(x: Column, eps: float = 1e-12) -> Column:
    return F.transform(x, lambda v: v / (norm(x) + eps))


def project(x: Column, mean: list[float], std: list[float], weights: list[list[float]]) -> Column:
    z = F.zip_with(F.zip_with(x, F.array(*map(F.lit, mean)), lambda a, b: a - b), F.array(*map(F.lit, std)), lambda a, s: a / s)
    return F.array(*[dot(z, F.array(*map(F.lit, w))) for w in weights])


def distance(p: Column, q: Column) -> Column:
    """From direct differences."""
    return F.sqrt(sum((F.pow(p[c] - q[c], 2) for c in ("y", "z")), F.pow(p["x"] - q["x"], 2)))


def minimum_distance(positions: Column) -> Column:
    """Least pair distance of an array of points, NaN above all others; infinite where no pair has one."""
    n = F.size(positions)
    each = F.transform(positions, lambda p, i: F.array_min(F.transform(F.slice(positions, i + 2, n), lambda q: distance(p, q))))
    return F.coalesce(F.array_min(each), F.lit(float("inf")))


def radius_of_gyration(positions: Column) -> Column:
    n = F.size(positions)
    mean = lambda c: F.aggregate(positions, F.lit(0.0), lambda s, p: s + p[c]) / n
    centre = F.struct(*[mean(c).alias(c) for c in "xyz"])
    total = F.get(F.transform(F.array(centre), lambda m: F.aggregate(positions, F.lit(0.0), lambda s, p: s + F.pow(distance(p, m), 2))), F.lit(0))
    return F.sqrt(total / n)


def geometry_violations(numbers: Column, minimum: Column, rules: dict[str, float]) -> Column:
    """Names of violated limits in order; heavy = 0, H = 0 and the H share exclude each other."""
    heavy, hydrogen = F.size(F.filter(numbers, lambda z: z > 1)), F.size(F.filter(numbers, lambda z: z == 1))
    share = F.when(heavy == 0, "no_heavy_atoms").when(hydrogen == 0, "no_hydrogens").when(hydrogen / heavy > rules["max_h_per_heavy"], "too_many_hydrogens")
    near = F.when(minimum < rules["min_distance"], "atoms_too_close")
    size = F.when(F.size(numbers) > rules["max_atoms"], "too_many_atoms")
    return F.filter(F.array(size, near, share), lambda x: x.isNotNull())


def first_reason(*reasons: Column) -> Column:
    """The first reason that isn't null."""
    return F.coalesce(*reasons)


def molecule_gates(numbers: Column, fragments: Column, charge: Column, radicals: Column, isotopes: Column, *, most_atoms: int | None = 100,
                   elements: list[int] | None = None, charged: bool = True, radical: bool = True, isotope: bool = False, several: bool = False) -> Column:
    """Whether a molecule passes: three atoms at least, most_atoms at most, its elements, and what else isn't allowed.  The last two
    features are arrays, an entry for each atom; a molecule that couldn't be read (a null feature) doesn't pass."""
    n = F.size(numbers)
    gates = [n >= 3]
    if most_atoms is not None:
        gates.append(n <= most_atoms)
    if not several:
        gates.append(fragments <= 1)
    if not charged:
        gates.append(charge == 0)
    if elements is not None:
        gates.append(F.forall(numbers, lambda z: z.isin(elements)))
    if not radical:
        gates.append(F.forall(radicals, lambda r: r == 0))
    if not isotope:
        gates.append(F.forall(isotopes, lambda i: i == 0))
    read = reduce(lambda a, b: a & b, (x.isNotNull() for x in (numbers, fragments, charge, radicals, isotopes)))
    return F.coalesce(read & reduce(lambda a, b: a & b, gates), F.lit(False))
