"""Frames, order, evaluation and projections on small rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import evaluation, frames, splits
from lattica.operators.order import dense_ids, running
from lattica.plans import selection


def test_order_by_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.randint(0, 9)) for i in r.sample(range(1000), 300)]
    d = spark.createDataFrame(rows, "k string, pos long, n long").repartition(5)
    got = {x.pos: x.at for x in dense_ids(d, [F.col("pos")], "at").collect()}
    assert got == {p: i for i, p in enumerate(sorted(x[1] for x in rows))}
    got = {x.pos: x.below for x in running(d, ["k"], [F.col("pos")], {"below": F.col("n")}).collect()}
    assert got == {p: sum(m for j, q, m in rows if j == k and q < p) for k, p, _ in rows}
    assert dense_ids(d.where("false"), [F.col("pos")], "at").count() == 0


def test_keys_by_prefix(spark):
    d = spark.range(500).withColumnRenamed("id", "g")
    key = selection.draw_key(3, 0, "g")
    every = sorted(x.k for x in d.select(key.alias("k")).collect())
    assert [selection.smallest_keys(d, key, n, few) for n in (1, 77, 500) for few in (2, 4096)] == [every[n - 1] for n in (1, 77, 500) for _ in range(2)]
    assert selection.smallest_keys(d, key, 0) == ""
    s = splits.random_split(d, "g", 2, 0.1, 0.15).groupBy("split").count().collect()
    assert {x.split: x["count"] for x in s} == {"test": 50, "valid": 75, "train": 375}


def test_expansion_drops_orphans(spark):
    s = spark.createDataFrame([(0, 1, "a"), (1, 0, "b"), (2, 3, "c"), (3, 2, "d"), (4, None, "e")], "id long, partner long, y string")
    x = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0), (4, 0)], "id long, conformer long")
    c = spark.createDataFrame([(i, 0.0, 1.0) for i in range(5)], "id long, total_charge double, multiplicity double")
    order = [F.col("id"), F.col("conformer")]
    table, orphans = frames.expand(s, x, c, "id", "partner", order)
    got = sorted((r.structure_id, r.id, r.partner, r.conformer, r.y) for r in table.collect())
    assert orphans == 1 and got == [(0, 0, 1, 0, "a"), (1, 0, 1, 1, "a"), (2, 1, 0, 0, "b"), (3, 2, None, 0, "c"), (4, 4, None, 0, "e")]
    table, orphans = frames.expand(s, x, c, "id", "partner", order, require_pairs=True)
    assert orphans == 1 and sorted(r.id for r in table.collect()) == [0, 0, 1, 4]
    with pytest.raises(ValueError, match="no charge"):
        frames.expand(s, x, c.where("id <> 1"), "id", "partner", order)


def test_frames_that_are_missing(spark):
    f = spark.createDataFrame([(0, [6, 26]), (1, [6, 8])], "id long, numbers array<int>")
    with pytest.raises(KeyError):
        frames.take(f, spark.createDataFrame([(0,), (7,)], "id long"), "id")
    assert frames.take(f, spark.createDataFrame([(1,), (1,)], "id long"), "id").count() == 1
    metal = frames.sole_index(F.col("numbers"), F.array(F.lit(26)))
    assert f.where("id = 0").select(metal).first()[0] == 1
    with pytest.raises(Exception, match="one metal expected"):
        f.select(metal).collect()
    with pytest.raises(Exception, match="no charge for 1"):
        frames.with_charges(f, spark.createDataFrame([(0, 0.0)], "id long, total_charge double"), "id").collect()


def test_geometries(spark):
    at = lambda *ps: [dict(zip("xyz", map(float, p))) for p in ps]
    made = {
        "linear": at((1, 0, 0), (-1, 0, 0)), "bent": at((1, 0, 0), (0, 1, 0)), "tetrahedral": at((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)),
        "octahedral_like": at((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)), "monocoordinate": at((1, 0, 0)), "unknown": [],
        "trigonal_bipyramidal": at((0, 0, 1), (0, 0, -1), (1, 0, 0), (-0.5, 0.866, 0), (-0.5, -0.866, 0)),
    }
    d = spark.createDataFrame([(k, at((0, 0, 0))[0], v) for k, v in made.items()], "k string, m struct<x:double,y:double,z:double>, donors array<struct<x:double,y:double,z:double>>")
    got = d.select("k", frames.geometry_class(frames.donor_angles(F.col("m"), F.col("donors")), F.size("donors")).alias("g")).collect()
    assert all(r.k == r.g for r in got)


def test_noise_is_normal_and_repeats(spark):
    d = spark.range(2000).select("id", F.array(F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])).alias("p"))
    draw = lambda: np.array([[r.q[0][c] for c in "xyz"] for r in d.select(frames.noisy(F.col("p"), F.lit(2.0), 5, "id").alias("q")).collect()])
    a = draw()
    assert (a == draw()).all() and abs(a.mean()) < 0.15 and abs(a.std() - 2) < 0.1


def test_projection_is_the_svd(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(80, 5)) @ r.normal(size=(5, 5)) + 2
    d = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    fitted = evaluation.fit_projection(d, "v", 2)
    z = (v - v.mean(0)) / v.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(fitted["components"]), np.abs(vt[:2])) and np.allclose(fitted["explained"], (s**2 / (s**2).sum())[:2])
    got = np.array([x.s for x in d.select(evaluation.apply_projection(F.col("v"), fitted).alias("s")).collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T))
    with pytest.raises(ValueError):
        evaluation.fit_projection(d, "v", 6)


def test_logistic_is_at_its_optimum(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(120, 2)) * [1, 5] + 1
    y = (x @ [1.0, -0.3] + r.normal(size=120) > 0).astype(float)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w, b = evaluation.logistic(d, ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    v = w * x.std(0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(z.T @ (p - y) + v).max() < 1e-5 and abs((p - y).sum()) < 1e-5
    one = evaluation.logistic(d.withColumn("y", F.lit(1.0)), ["a"], "y")
    assert one[0][0] == 0 and one[1] > 30


def test_cells(spark):
    d = spark.createDataFrame([(i, float(i), 2.0 * i if i != 9 else None, "train" if i < 6 else "test") for i in range(10)], "id long, x double, y double, split string")
    r = evaluation.evaluate_cell(d, ["x"], ["y"], "split", "mean", "rmse").first()
    assert (r.target, r.n_train, r.n_valid, r.n_test) == ("y", 6, 0, 4) and r.value == pytest.approx(np.sqrt(np.mean([(2 * i - 5) ** 2 for i in (6, 7, 8)])))
    assert evaluation.metrics_with_headline("regression", "r2") == ("r2", "rmse", "mae", "spearman")
    assert evaluation.class_display_names(2) == ("class_0", "class_1")
    with pytest.raises(ValueError):
        evaluation.class_display_names(2, ("a",))
