"""Registered queries on frames by id, expansion, evaluation cells, profiles, and reports, each with its SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _DIST, _POINTS, frames, query, t
from .functions import exprs as X
from .operators import evaluation as E
from .operators import frames as FR
from .operators import prepare as P
from .operators import stats as ST
from .operators.order import dense_ids

# --- frames by id ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, CAST(count(*) AS INT) AS atoms FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def frames_by_id(spark, d):
    f = frames(spark, d)
    urgent = t(spark, d, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return FR.take(f, urgent.join(f.select("l_orderkey"), "l_orderkey", "left_semi"), "l_orderkey").select("l_orderkey", F.size("numbers").alias("atoms"))


@query("SELECT l_orderkey, CAST(count(*) AS INT) AS atoms FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 300 GROUP BY 1")
def frames_between(spark, d):
    return FR.between(frames(spark, d), "l_orderkey", 100, 300).select("l_orderkey", F.size("numbers").alias("atoms"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + (SELECT count(*) FROM nation), r_name FROM region")
def frames_concatenated(spark, d):
    a = t(spark, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = t(spark, d, "region", "r_regionkey", "r_name").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return FR.concatenate([a, b], "id")


@query("SELECT l_orderkey, CAST(count(*) AS INT) AS atoms, CAST(o_custkey % 3 - 1 AS DOUBLE) AS total_charge FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey")
def frames_with_charges(spark, d):
    c = t(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 3 - 1).cast("double").alias("total_charge"))
    f = frames(spark, d).join(c.select("l_orderkey"), "l_orderkey", "left_semi")
    return FR.with_charges(f, c, "l_orderkey").select("l_orderkey", F.size("numbers").alias("atoms"), "total_charge")


_EXPANDED = """WITH s AS (SELECT p_partkey AS id, xor(p_partkey, 1) AS partner, p_size FROM part), x AS (SELECT l_partkey AS id, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity > 45),
k AS (SELECT * FROM s WHERE id IN (SELECT id FROM x)), o AS (SELECT id, p_size, CASE WHEN partner IN (SELECT id FROM k) THEN partner END AS partner, partner NOT IN (SELECT id FROM k) AS orphan FROM k)
SELECT row_number() OVER (ORDER BY o.id, l_orderkey, l_linenumber, l_suppkey) - 1 AS structure_id, o.id, partner, l_orderkey, CAST(o.id % 3 - 1 AS DOUBLE) AS total_charge FROM o JOIN x ON x.id = o.id WHERE {keep}"""


def _expanded(spark, d, require_pairs):
    s = t(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_partkey").bitwiseXOR(F.lit(1).cast("long")).alias("partner"))
    x = t(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").where("l_quantity > 45").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", "l_suppkey")
    c = s.select("id", (F.col("id") % 3 - 1).cast("double").alias("total_charge"), F.lit(1.0).alias("multiplicity"))
    order = [F.col(k) for k in ("id", "l_orderkey", "l_linenumber", "l_suppkey")]
    return FR.expand(s, x, c, "id", "partner", order, require_pairs)[0].select("structure_id", "id", "partner", "l_orderkey", "total_charge")


@query(_EXPANDED.format(keep="true"))
def expand_to_structures(spark, d):
    return _expanded(spark, d, False)


@query(_EXPANDED.format(keep="NOT orphan"))
def expand_pairs_only(spark, d):
    return _expanded(spark, d, True)


# --- frame features ----------------------------------------------------------------------------------------------------


@query(f"""WITH p AS ({_POINTS}), m AS (SELECT l_orderkey, px, py, pz FROM p WHERE i = 1), v AS (SELECT p.l_orderkey, p.i, p.px - m.px AS x, p.py - m.py AS y, p.pz - m.pz AS z FROM p JOIN m USING (l_orderkey) WHERE p.i > 1),
u AS (SELECT l_orderkey, i, x / k AS x, y / k AS y, z / k AS z FROM (SELECT *, CASE WHEN sqrt(x * x + y * y + z * z) > 0 THEN sqrt(x * x + y * y + z * z) ELSE 1 END AS k FROM v)),
g AS (SELECT a.l_orderkey, list_sort(list(degrees(acos(least(greatest(a.x * b.x + a.y * b.y + a.z * b.z, -1), 1))))) AS g FROM u a JOIN u b ON a.l_orderkey = b.l_orderkey AND a.i < b.i GROUP BY 1), n AS (SELECT l_orderkey, count(*) - 1 AS cn FROM p GROUP BY 1)
SELECT l_orderkey, CASE WHEN cn <= 0 THEN 'unknown' WHEN cn = 1 THEN 'monocoordinate' WHEN cn = 2 THEN CASE WHEN g[1] > 160 THEN 'linear' ELSE 'bent' END WHEN cn = 3 THEN CASE WHEN list_avg(g) > 110 AND list_avg(g) < 130 THEN 'trigonal_planar' ELSE 'T-shape' END
WHEN cn = 4 THEN CASE WHEN list_avg(g) > 100 THEN 'tetrahedral' ELSE 'square_planar' END WHEN cn = 5 THEN CASE WHEN (g[-1] - g[-2]) / 60 > 0.5 THEN 'trigonal_bipyramidal' ELSE 'square_pyramidal' END
WHEN cn = 6 THEN CASE WHEN len([a for a in g if a > 75 AND a < 105]) >= 10 AND len([a for a in g if a > 160]) >= 2 THEN 'octahedral_like' ELSE 'distorted_6' END ELSE 'high_cn_' || cn END AS geometry FROM n LEFT JOIN g USING (l_orderkey)""")
def coordination_geometry(spark, d):
    """The first atom is the centre, all others its donors."""
    f = frames(spark, d).select("l_orderkey", F.get("positions", F.lit(0)).alias("m"), F.slice("positions", 2, 1 << 20).alias("donors"))
    return f.select("l_orderkey", FR.geometry_class(FR.donor_angles(F.col("m"), F.col("donors")), F.size("donors")).alias("geometry"))


@query(f"WITH p AS ({_POINTS}) SELECT a.l_orderkey, CAST(count(*) FILTER (b.z = 3 AND {_DIST} > 2 AND {_DIST} < 12) AS INT) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey WHERE a.i = 1 GROUP BY 1")
def shell_counts(spark, d):
    f = frames(spark, d)
    return f.select("l_orderkey", FR.shell_count(F.col("numbers"), F.col("positions"), F.get("positions", F.lit(0)), 3, 2.0, 12.0).alias("n"))


@query("SELECT l_orderkey, list_sort(list(CASE WHEN z <> 1 THEN z END)) = list_sort(list(CASE WHEN e <> 1 THEN e END)) AS heavy_agree, CAST(count(*) FILTER (z = 1) AS INT) AS h, CAST(count(*) FILTER (e = 1) AS INT) AS expected_h FROM (SELECT l_orderkey, l_linenumber % 4 AS z, CASE WHEN l_tax > 0.07 THEN 1 ELSE l_linenumber % 4 END AS e FROM lineitem) GROUP BY 1".replace("list(CASE WHEN z <> 1 THEN z END)", "coalesce(list(z) FILTER (z <> 1), [])").replace("list(CASE WHEN e <> 1 THEN e END)", "coalesce(list(e) FILTER (e <> 1), [])"))
def composition_check(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_tax").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber") % 4).alias("z"), F.collect_list(F.when(F.col("l_tax") > 0.07, 1).otherwise(F.col("l_linenumber") % 4)).alias("e"))
    return li.select("l_orderkey", (FR.composition(F.col("z")) == FR.composition(F.col("e"))).alias("heavy_agree"), FR.hydrogens(F.col("z")).alias("h"), FR.hydrogens(F.col("e")).alias("expected_h"))


@query("SELECT l_orderkey, CAST(count(*) AS INT) AS n_chiral, CASE WHEN list(l_linestatus ORDER BY l_linenumber) = ['O'] THEN 1 ELSE 0 END AS rs, CAST(sign(round(min(l_discount) - 0.02, 2)) AS INT) AS or_sign FROM lineitem GROUP BY 1")
def entry_labels(spark, d):
    g = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_discount").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus"))), lambda s: s["l_linestatus"]).alias("c"), F.round(F.min("l_discount") - 0.02, 2).alias("rotation"))
    return g.select("l_orderkey", F.size("c").alias("n_chiral"), (F.col("c") == F.array(F.lit("O"))).cast("int").alias("rs"), FR.sign(F.col("rotation")).alias("or_sign"))


@query("SELECT l_orderkey, CAST(list_position(list(l_linenumber ORDER BY l_linenumber), 1) - 1 AS INT) AS metal FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) = 1")
def metal_index(spark, d):
    """Only frames with one such atom are asked; others are an error."""
    g = t(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("z")).where(F.size(F.filter("z", lambda z: z == 1)) == 1)
    return g.select("l_orderkey", FR.sole_index(F.col("z"), F.array(F.lit(1))).alias("metal"))


@query(f"WITH p AS ({_POINTS}), n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (z = 3) AS k FROM p GROUP BY 1), c AS (SELECT a.l_orderkey, count(*) AS c FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.i < b.i WHERE {_DIST} < 2 GROUP BY 1) SELECT coalesce(CASE WHEN n > 6 THEN 'composition' WHEN k < 1 THEN 'haptic' WHEN c > 0 THEN 'clash' END, 'kept') AS reason, count(*) AS n FROM n LEFT JOIN c USING (l_orderkey) GROUP BY 1")
def rebuild_reasons(spark, d):
    """The first gate that a rebuilt frame fails: composition, bound ring atoms, clashes."""
    f = frames(spark, d)
    reason = X.first_reason(F.when(F.size("numbers") > 6, "composition"), F.when(F.size(F.filter("numbers", lambda z: z == 3)) < 1, "haptic"), F.when(X.minimum_distance(F.col("positions")) < 2, "clash"))
    return P.account(f.withColumn("r", reason), "r")


# --- evaluation --------------------------------------------------------------------------------------------------------

_PARTS = "WITH s AS (SELECT *, CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM part), n AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'valid') AS n_valid, count(*) FILTER (split = 'test') AS n_test FROM s) "


def _split_parts(spark, d):
    k = F.col("p_partkey") % 10
    return t(spark, d, "part").withColumn("split", F.when(k < 7, "train").when(k < 8, "valid").otherwise("test")).withColumns({"price": F.col("p_retailprice"), "size": F.col("p_size").cast("double"), "key": (F.col("p_partkey") % 100).cast("double")})


@query(_PARTS + "SELECT y AS target, 'mean' AS learner, 'rmse' AS metric, round(value, 5) AS value, n_train, n_valid, n_test FROM (SELECT 'price' AS y, (SELECT sqrt(avg((p_retailprice - m) ** 2)) FROM s, (SELECT avg(p_retailprice) AS m FROM s WHERE split = 'train') WHERE split = 'test') AS value UNION ALL SELECT 'size', (SELECT sqrt(avg((p_size - m) ** 2)) FROM s, (SELECT avg(p_size) AS m FROM s WHERE split = 'train') WHERE split = 'test')), n")
def evaluation_cells(spark, d):
    e = E.evaluate_cell(_split_parts(spark, d), ["key"], ["price", "size"], "split", "mean", "rmse")
    return e.withColumn("value", F.round("value", 5))


@query(_PARTS + ", f AS (SELECT regr_slope(p_retailprice, x) * count(*) * var_pop(x) / (count(*) * var_pop(x) + var_pop(x)) AS w, avg(p_retailprice) AS my, avg(x) AS mx FROM (SELECT p_retailprice, (p_partkey % 100)::DOUBLE AS x FROM s WHERE split = 'train')) SELECT 'price' AS target, 'ridge' AS learner, 'mae' AS metric, round(avg(abs(p_retailprice - my - w * ((p_partkey % 100) - mx))), 5) AS value, any_value(n_train) AS n_train, any_value(n_valid) AS n_valid, any_value(n_test) AS n_test FROM s, f, n WHERE split = 'test'")
def evaluation_cell_ridge(spark, d):
    """With one standardised feature the ridge solution is closed: the slope shrunk by n / (n + 1)."""
    return E.evaluate_cell(_split_parts(spark, d), ["key"], ["price"], "split", "ridge", "mae").withColumn("value", F.round("value", 5))


@query("SELECT m AS metric, m NOT IN ('rmse', 'mae') AS higher_is_better FROM (SELECT unnest(['rmse', 'mae', 'r2', 'spearman', 'auroc', 'auprc', 'macro_auroc', 'balanced_accuracy', 'macro_f1', 'pair_ranking_accuracy']) AS m)")
def metric_directions(spark, d):
    return spark.createDataFrame(list(E.HIGHER_IS_BETTER.items()), "metric string, higher_is_better boolean")


@query("""WITH x AS (SELECT source AS cluster, lang AS label, n_chars, n_chars % 2 = 0 AS flag FROM documents), n AS (SELECT cluster, label, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT cluster, label, n, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY cluster) AS p FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM p), q AS (SELECT cluster, round(max(p), 6) AS purity, round(sum(-p * log2(p)), 6) AS bits, string_agg(CASE WHEN r <= 2 THEN label || ':' || n END, ',' ORDER BY r) AS top FROM r GROUP BY 1)
SELECT cluster, count(*) AS size, round(avg(n_chars), 4) AS mean_n_chars, round(avg(CAST(flag AS INT)), 6) AS share_flag, any_value(purity) AS purity, any_value(bits) AS bits, any_value(top) AS top FROM x JOIN q USING (cluster) GROUP BY 1""")
def cluster_profiles(spark, d):
    x = t(spark, d, "documents", "source", "lang", "n_chars").select(F.col("source").alias("cluster"), F.col("lang").alias("label"), "n_chars", (F.col("n_chars") % 2 == 0).alias("flag"))
    p = E.cluster_profiles(x, "cluster", "label", ["n_chars"], ["flag"], ["label"], 2)
    top = F.array_join(F.transform("top_label", lambda s: F.concat_ws(":", s["value"], s["n"])), ",")
    return p.select("cluster", "size", F.round("mean_n_chars", 4).alias("mean_n_chars"), F.round("share_flag", 6).alias("share_flag"), F.round("purity", 6).alias("purity"), F.round("bits", 6).alias("bits"), top.alias("top"))


@query()
def projection_scores(spark, d):
    """Top two principal components; checked against a singular value decomposition in the tests."""
    e = t(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform(E.apply_projection(F.col("embedding"), E.fit_projection(e, "embedding", 2)), lambda v: F.round(v, 5)).alias("scores"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_samp(x) AS s FROM e GROUP BY 1), z AS (SELECT vec_id, dim, (x - m) / s AS z FROM e JOIN s USING (dim)),
u AS (SELECT vec_id, dim, z / (sqrt(sum(z * z) OVER (PARTITION BY vec_id)) + 1e-12) AS u FROM z), c0 AS (SELECT dim, avg(u) AS m FROM u GROUP BY 1), v AS (SELECT vec_id, dim, u - m AS u FROM u JOIN c0 USING (dim)),
c AS (SELECT a.dim AS i, b.dim AS j, sum(a.u * b.u) / ((SELECT count(*) FROM embeddings) - 1) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i = j THEN c END) ** 2 / sum(CASE WHEN i = j THEN 1 ELSE 2 END * c * c), 4) AS participation_ratio, round(sum(CASE WHEN i = j THEN c END), 6) AS trace, (SELECT count(*) FROM embeddings) AS n FROM c""")
def capacity_diagnostic(spark, d):
    c = E.capacity_diagnostic(t(spark, d, "embeddings", "embedding"), "embedding")
    return c.select(F.round("participation_ratio", 4).alias("participation_ratio"), F.round("trace", 6).alias("trace"), F.col("n").cast("long").alias("n"))


# --- reports -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS run, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O') AS kept FROM orders GROUP BY 1")
def reason_pivot(spark, d):
    return P.reasons_by_run(t(spark, d, "orders", "o_orderpriority", "o_orderstatus").withColumn("reason", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending")), "o_orderpriority", "reason", ["failed", "pending"]).withColumnRenamed("o_orderpriority", "run")


@query("SELECT count(*) AS \"rows\", count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) > 0) AS not_finite, count(*) - count(DISTINCT vec_id) AS repeated FROM embeddings")
def embedding_problems(spark, d):
    return ST.vector_problems(t(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)


@query("SELECT count(*) AS \"rows\", count(*) FILTER (p_retailprice IS NULL OR isnan(p_retailprice)) AS no_charge, count(*) FILTER (p_name IS NULL) AS no_smiles FROM part")
def row_checks(spark, d):
    p = t(spark, d, "part", "p_retailprice", "p_name")
    return p.agg(F.count("*").alias("rows"), F.count_if(F.col("p_retailprice").isNull()).alias("no_charge"), F.count_if(F.col("p_name").isNull()).alias("no_smiles"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, md5('9:1:' || doc_id), doc_id) - 1 AS place FROM documents")
def epoch_order(spark, d):
    """An epoch's order: by length, equal lengths in seeded order."""
    x = t(spark, d, "documents", "doc_id", "n_chars")
    from .plans.selection import draw_key

    return dense_ids(x, [F.col("n_chars"), draw_key(9, 1, "doc_id"), F.col("doc_id")], "place").select("doc_id", "place")


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN 0 WHEN p_size < 60 THEN 1 ELSE 2 END AS size, CASE WHEN z BETWEEN 21 AND 30 THEN 1 WHEN z BETWEEN 39 AND 48 THEN 2 WHEN z BETWEEN 57 AND 71 THEN 4 WHEN z BETWEEN 72 AND 80 THEN 3 WHEN z BETWEEN 89 AND 103 THEN 5 ELSE 0 END AS block FROM (SELECT p_partkey, p_size, p_partkey % 110 AS z FROM part)")
def plot_colours(spark, d):
    """Numbers for a plot's colours: the band of the size, the block of the element."""
    p = t(spark, d, "part", "p_partkey", "p_size")
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c).cast("int") - 1
    return p.select("p_partkey", place(["small", "medium", "large"], X.size_band(F.col("p_size"))).alias("size"), place(["main", "3d", "4d", "5d", "4f", "5f"], X.element_block(F.col("p_partkey") % 110)).alias("block"))


_PANEL = "SELECT l_returnflag, l_suppkey, l_linenumber AS model, sum(l_quantity) AS score FROM lineitem GROUP BY ALL"
_CELLS = f"""panel AS ({_PANEL}), capacity AS (SELECT l_linenumber AS model, round(sum(l_tax * 100 + 1)) % 97 AS d_eff FROM lineitem GROUP BY 1),
  whole AS (SELECT l_returnflag, l_suppkey FROM panel GROUP BY ALL HAVING count(DISTINCT model) >= (SELECT count(*) FROM capacity) AND count(DISTINCT score) >= 3),
  x AS (SELECT * FROM panel JOIN whole USING (l_returnflag, l_suppkey) JOIN capacity USING (model)),
  r AS (SELECT l_returnflag, l_suppkey, rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY score) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, score) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY d_eff) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey, d_eff) - 1) / 2.0::DOUBLE AS b FROM x),
  cells AS (SELECT l_returnflag, l_suppkey, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY ALL)"""


def _correlated(spark, d):
    x = t(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_linenumber", "l_quantity", "l_tax").withColumnRenamed("l_linenumber", "model")
    panel = x.groupBy("l_returnflag", "l_suppkey", "model").agg(F.sum("l_quantity").alias("score"))
    capacity = x.groupBy("model").agg((F.round(F.sum(F.col("l_tax") * 100 + 1)) % 97).alias("d_eff"))
    return E.correlate_cells(panel, capacity, ["l_returnflag", "l_suppkey"], "model", "score", "d_eff").withColumn("spearman", F.round("spearman", 6) + F.lit(0.0))  # no zero below 0


@query(f"WITH {_CELLS} SELECT l_returnflag, l_suppkey, spearman FROM cells")
def capacity_correlation(spark, d):
    return _correlated(spark, d)


@query(f"WITH {_CELLS}, g AS (SELECT 'all' AS \"group\", spearman AS v FROM cells UNION ALL SELECT 'l_returnflag=' || l_returnflag, spearman FROM cells) SELECT \"group\", round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive, count(*) AS n FROM g GROUP BY 1")
def capacity_summary(spark, d):
    s = E.summary_by_kind(_correlated(spark, d), "l_returnflag", "spearman")
    return s.select("group", *[F.round(c, 6).alias(c) for c in ("median", "mean", "share_positive")], "n")


@query("SELECT l_orderkey, n >= 3 AND n <= 6 AND o_custkey % 4 < 2 AND o_custkey % 3 = 1 AND elements AND isotopes AS passes FROM (SELECT l_orderkey, count(*) AS n, bool_and(l_linenumber % 9 + 1 IN (2, 3, 4, 5, 6, 7)) AS elements, bool_and(l_linenumber % 9 + 1 <> 9) AS isotopes FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey")
def molecule_gates(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    f = frames(spark, d).drop("positions").join(o, "l_orderkey")
    zeros = F.transform("numbers", lambda z: F.lit(0))
    isotopes = F.transform("numbers", lambda z: F.when(z == 9, 18).otherwise(0))
    gates = X.molecule_gates(F.col("numbers"), F.col("o_custkey") % 4, F.col("o_custkey") % 3 - 1, zeros, isotopes, most_atoms=6, elements=[2, 3, 4, 5, 6, 7], charged=False, radical=False)
    return f.select("l_orderkey", gates.alias("passes"))
