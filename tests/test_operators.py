"""Rules that the stand-in tables don't exercise, on small rows."""
import math

import pytest
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.operators import learners, metrics, prepare, splits, stats
from lattica.plans import selection
from lattica.plans.spec import Label, Spec, log10_label, split_code
from lattica.sources import sinks, tables


def test_tied_vote_is_missing(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 2, 1), ("b", 3, 1), ("b", 4, 0), ("c", 5, None)], "k string, pos int, c int")
    got = {r.k: (r.c, r.c_tied) for r in prepare.merge_replicates(d, "k", "pos", [], ["c"]).collect()}
    assert got == {"a": (None, True), "b": (1, False), "c": (None, None)}


def test_draws_nest_and_stand_removal(spark):
    d = spark.range(200).withColumnRenamed("id", "g")
    ids = lambda f, **k: {r.g for r in selection.random_groups(f, "g", 1, **k).collect()}
    small, large = ids(d, count=20), ids(d, count=50)
    assert small < large
    gone = next(iter(large - small))
    assert ids(d.where(F.col("g") != gone), count=20) == small
    with pytest.raises(ValueError):
        ids(d, count=201)
    assert selection.exact_floor(0.29, 100) == 29


def test_filter_errors_are_named(spark):
    with pytest.raises(ValueError, match="filter"):
        selection.where(spark.range(3), "nothing_like_it > 1").collect()


def test_spec_rules():
    assert [f.name for f in Spec(labels=(Label("y"),), splits=("split",)).struct()][-2:] == ["y", "split"]
    for bad in (lambda: Label("y", "multiclass"), lambda: Label("y", "classification", log10=(0, 1)), lambda: Spec(labels=(Label("y"), Label("y"))), lambda: Spec(splits=("split",)), lambda: Spec(labels=(Label("y"),), splits=("part",))):
        with pytest.raises(ValueError):
            bad()


def test_missing_stays_missing(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-5.0,)], "y double")
    assert [r[0] for r in d.select(log10_label(F.col("y"))).collect()] == [math.log10(2), None, None, 0.0]
    assert [r.y for r in tables.nan_to_null(d).collect()] == [1.0, None, None, -5.0]
    with pytest.raises(Exception, match="unknown split"):
        spark.createDataFrame([("tset",)], "s string").select(split_code(F.col("s"))).collect()


def test_empty_fingerprints_are_alike(spark):
    d = spark.createDataFrame([([0, 0], [0, 0]), ([3, 0], [1, 4])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in d.select(X.tanimoto(F.col("a"), F.col("b"))).collect()] == [1.0, 1 / 3]


def test_fold_skips_and_continues(spark):
    g = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "g string, n int")
    got = {r.g: r.split for r in splits.greedy_fold(g, "g", "n", [-F.col("n")], 0.7, 0.1).collect()}
    assert got == {"a": "train", "b": "test", "c": "train"}


def test_batches_hold_their_budget(spark):
    d = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 4, 50, 5])], "id long, n long")
    got = {r.id: r.batch for r in splits.length_batches(d, F.lit(0), "id", "n", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 5: 1, 4: 2}


def test_pair_ranking_ties(spark):
    rows = [(0, 1, 1.0, 5.0), (1, 0, 2.0, 5.0), (2, 3, 1.0, 1.0), (3, 2, 1.0, 9.0), (4, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id long, o long, y double, p double")
    r = metrics.pair_ranking(d, "id", "o", "y", "p").first()
    assert (r.accuracy, r.pairs) == (0.5, 1)


def test_single_class_has_no_auroc(spark):
    d = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, p double")
    assert metrics.auroc(d, [], "y", "p").first().auroc is None


def test_constant_dimension_has_no_entropy(spark):
    d = spark.createDataFrame([([1.0, 0.0],), ([1.0, 1.0],)], "v array<double>")
    assert {r.dim: r.bits for r in stats.marginal_entropy(d, "v", 4).collect()} == {0: 0.0, 1: 1.0}


def test_ridge_is_exact(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 2)), r.normal(size=50)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w, b = learners.ridge(d, ["a", "b"], "y", 1.0)
    z = (x - x.mean(0)) / x.std(0)
    v = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(w, v / x.std(0)) and np.isclose(b, y.mean() - (v / x.std(0)) @ x.mean(0))


def test_leaders_cover_everyone(spark):
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3)]
    p = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.leader for r in learners.leader_clusters(p, spark.range(6), "id").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_leaders_of_vectors_with_copies(spark, tmp_path, monkeypatch):
    """Against one leader at a time over all pairs; copies are not expanded, and blocks split groups."""
    import numpy as np

    from lattica import catalog

    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 6))
    v = [[float(np.float32(x)) for x in centres[i % 9] + r.normal(0, 0.6, 6)] for i in range(90)]
    made = [(i, v[i] if i < 90 else v[(i * 7) % 30], (i if i < 90 else (i * 7) % 30) % 2) for i in range(150)] + [(150, [0.0] * 6, 0), (151, v[0], None), (152, None, 0)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    cos = lambda x, y: np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))
    near = {i: {j for j, y, m in made[:150] if m == k and cos(x, y) >= 0.6} for i, x, k in made[:150]} | {i: {i} for i in (150, 151, 152)}
    open_, want = set(near), {}
    while open_:
        lead = max(open_, key=lambda i: (len(near[i] & open_), -i))
        want |= {i: lead for i in near[lead] & open_}
        open_ -= near[lead]
    seen, plain = [], learners.near_pairs

    def small(*a):
        out = plain(*a, block=8)
        seen.append(out.count())
        return out

    monkeypatch.setattr(learners, "near_pairs", small)
    got = catalog.QUERIES["leader_clusters"](spark, str(tmp_path)).collect()
    assert len(got) == 153 and {x.vec_id: x.leader for x in got} == want
    assert seen == [sum(len({j for j in near[i] if j < 90}) - 1 for i in range(90))]


def test_bundles_are_whole_or_absent(spark, tmp_path):
    d = spark.createDataFrame([(i, -0.0 if i else 0.0) for i in range(5)], "id long, y double")
    path = str(tmp_path / "b")
    record = sinks.write_bundle(d, path, ["id"])
    assert record["rows"] == 5 and sinks.read_bundle(spark, path, ["id"]).count() == 5
    with pytest.raises(FileExistsError):
        sinks.write_bundle(d, path, ["id"])
    sinks.write_bundle(d.limit(3), path, ["id"], replace=True)
    assert sinks.read_bundle(spark, path, ["id"]).count() == 3
    d.limit(1).write.mode("overwrite").parquet(f"{path}/table")
    with pytest.raises(ValueError):
        sinks.read_bundle(spark, path, ["id"])
    assert tables.discover(spark, str(tmp_path), "manifest.json") == [path]


def test_xyz_blocks(spark, tmp_path):
    (tmp_path / "x.xyz").write_text("2\nCSD=ABC|q=1\nH 0 0 0\nH 0 0 1\n\n1\nCSD=D|q=0\nO 0 0 0\n")
    got = [(r.n_atoms, r.fields["CSD"], len(r.atoms)) for r in tables.read_xyz(spark, str(tmp_path / "x.xyz")).collect()]
    assert got == [(2, "ABC", 2), (1, "D", 1)]


def test_shards_of_a_stream(spark, tmp_path):
    from lattica.streaming import folds

    src = tmp_path / "in"
    spark.range(10).write.parquet(str(src))
    q = folds.process_shards(spark.readStream.schema("id long").parquet(str(src)), lambda b: b.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
