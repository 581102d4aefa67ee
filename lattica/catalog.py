"""Every registered query with its SQL.  Tables stand in for the roles named in each query's docstring or name."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import learners as L
from .operators import metrics as M
from .operators import prepare as P
from .operators import splits as SP
from .operators import stats as ST
from .plans import selection as SE
from .plans.spec import Label, Spec, log10_label, normalize_table, split_code
from .sources import tables as S
from .streaming import folds as ST_F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return S.read_table(spark, f"{d}/{name}.parquet", list(columns) or None)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- scans and projections ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 25")
def scan_pruned(spark, d):
    return t(spark, d, "part", "p_partkey", "p_brand", "p_size").where("p_size > 25")


@query("SELECT count(*) AS n FROM lineitem")
def table_row_count(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*").alias("n"))


@query("SELECT vec_id, len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AS ok FROM embeddings")
def embeddings_scan(spark, d):
    return S.read_embeddings(spark, f"{d}/embeddings.parquet", 64).select("vec_id", "ok")


@query("SELECT c_custkey, TRY_CAST(c_name AS DOUBLE) AS name_number, TRY_CAST(replace(c_name, 'Customer#', '') AS DOUBLE) AS key_number FROM customer")
def numeric_or_null(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_name").withColumn("bare", F.expr("replace(c_name, 'Customer#', '')"))
    return c.select("c_custkey", S.numeric_or_null("c_name").alias("name_number"), S.numeric_or_null("bare").alias("key_number"))


@query("SELECT 0 AS file_ord, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region")
def ordered_sources(spark, d):
    a = t(spark, d, "nation").select(F.lit(0).alias("file_ord"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return a.unionByName(t(spark, d, "region").select(F.lit(1).alias("file_ord"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("SELECT s_suppkey, [CAST(6 + s_suppkey % 3 AS INT), CAST(6 + s_nationkey % 3 AS INT)] AS numbers FROM supplier")
def decode_one_hot(spark, d):
    s = t(spark, d, "supplier", "s_suppkey", "s_nationkey")
    row = lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == k % 3).cast("double"))
    pad = F.array(*[F.lit(0.0)] * 3)
    return s.select("s_suppkey", S.decode_one_hot(F.array(row(F.col("s_suppkey")), row(F.col("s_nationkey")), pad), [6, 7, 8]).alias("numbers"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS stereoisomer_id, CAST(s_nationkey AS BIGINT) AS molecule_id, CAST(NULL AS BIGINT) AS enantiomer_of, CAST(s_acctbal AS DOUBLE) AS y, 'train' AS split, s_name FROM supplier")
def normalize_declared(spark, d):
    spec = Spec(labels=(Label("y"),), splits=("split",), default_split="split", smiles=False)
    s = t(spark, d, "supplier").select("s_name", F.lit("train").alias("split"), F.col("s_acctbal").alias("y"), F.col("s_nationkey").alias("molecule_id"), F.col("s_suppkey").alias("stereoisomer_id"), F.lit(None).alias("enantiomer_of"))
    return normalize_table(s, spec.struct())


@query("SELECT p_partkey, round(CASE WHEN v IS NOT NULL THEN log10(greatest(v, 0.0::DOUBLE) + 1.0::DOUBLE) END, 6) AS y FROM (SELECT p_partkey, nullif(p_retailprice, 901.0) - 1000 AS v FROM part)")
def log10_transform(spark, d):
    v = F.nullif(F.col("p_retailprice"), F.lit(901.0)) - 1000
    return t(spark, d, "part", "p_partkey", "p_retailprice").select("p_partkey", F.round(log10_label(v), 6).alias("y"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 255 END AS code FROM orders")
def split_codes(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "valid").otherwise("unassigned")
    return t(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", split_code(s).alias("code"))


@query("SELECT l_orderkey, count(*) AS atom_count FROM lineitem GROUP BY 1")
def atom_counts(spark, d):
    return frames(spark, d).select("l_orderkey", F.size("numbers").cast("long").alias("atom_count"))


@query("""SELECT p_partkey, CASE WHEN z BETWEEN 21 AND 30 THEN '3d' WHEN z BETWEEN 39 AND 48 THEN '4d' WHEN z BETWEEN 57 AND 71 THEN '4f' WHEN z BETWEEN 72 AND 80 THEN '5d' WHEN z BETWEEN 89 AND 103 THEN '5f' ELSE 'main' END AS block,
CASE WHEN p_size < 25 THEN 'small' WHEN p_size < 60 THEN 'medium' ELSE 'large' END AS band FROM (SELECT *, p_partkey % 110 AS z FROM part)""")
def element_rows(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_size")
    return p.select("p_partkey", X.element_block(F.col("p_partkey") % 110).alias("block"), X.size_band(F.col("p_size")).alias("band"))


@query("SELECT p_partkey, (CASE WHEN a > 0 THEN 'C' || a ELSE '' END) || 'N' || b || 'O' || c AS signature, CASE WHEN a >= b + c THEN 'carbon' WHEN b > c THEN 'nitrogen' ELSE 'oxygen' END AS label FROM (SELECT p_partkey, p_partkey % 4 AS a, p_size % 3 + 1 AS b, p_partkey % 5 + 1 AS c FROM part)")
def donor_signatures(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_size")
    a, b, c = F.col("p_partkey") % 4, F.col("p_size") % 3 + 1, F.col("p_partkey") % 5 + 1
    text = F.concat(F.lit("O"), c.cast("string"), F.when(a > 0, F.concat(F.lit("C"), a.cast("string"))).otherwise(""), F.lit("N"), b.cast("string"))
    m = p.select("p_partkey", X.donor_counts(text).alias("m"))
    n = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("p_partkey", X.donor_signature(F.col("m")).alias("signature"), F.when(n("C") >= n("N") + n("O"), "carbon").when(n("N") > n("O"), "nitrogen").otherwise("oxygen").alias("label"))


# --- frames ------------------------------------------------------------------------------------------------------------

_POINTS = "SELECT l_orderkey, l_linenumber % 9 + 1 AS z, l_quantity AS px, l_discount * 100 AS py, l_tax * 100 AS pz, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem"
_DIST = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))"


def frames(spark, d):
    """Ragged frames, a row each: numbers and positions as arrays (lineitems of an order)."""
    atom = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_linenumber") % 9 + 1).alias("z"), F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z")).alias("p"))
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(atom)).alias("a"))
    return a.select("l_orderkey", F.transform("a", lambda s: s["z"]).alias("numbers"), F.transform("a", lambda s: s["p"]).alias("positions"))


@query(f"WITH p AS ({_POINTS}) SELECT a.l_orderkey, round(coalesce(min(CASE WHEN b.i > a.i THEN {_DIST} END), 'inf'::DOUBLE), 6) AS min_distance FROM p a JOIN p b USING (l_orderkey) GROUP BY 1")
def min_distance(spark, d):
    """A null key joins nothing, and NaN stays: it isn't null to the SQL.  The order of points doesn't matter to the least."""
    p = F.struct(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    a = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.collect_list(p).alias("positions"))
    return a.select("l_orderkey", F.round(X.minimum_distance(F.col("positions")), 6).alias("min_distance"))


@query(f"""WITH p AS ({_POINTS}), m AS (SELECT a.l_orderkey, coalesce(min(CASE WHEN b.i > a.i THEN {_DIST} END), 'inf'::DOUBLE) AS m FROM p a JOIN p b USING (l_orderkey) GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (z > 1) AS heavy, count(*) FILTER (z = 1) AS h FROM p GROUP BY 1)
SELECT l_orderkey, concat_ws(',', CASE WHEN n > 6 THEN 'too_many_atoms' END, CASE WHEN m < 5 THEN 'atoms_too_close' END, CASE WHEN heavy = 0 THEN 'no_heavy_atoms' WHEN h = 0 THEN 'no_hydrogens' WHEN h * 1.0 / heavy > 0.4 THEN 'too_many_hydrogens' END) AS violations FROM m JOIN n USING (l_orderkey)""")
def frame_gate(spark, d):
    f = frames(spark, d).withColumn("m", X.minimum_distance(F.col("positions")))
    return f.select("l_orderkey", F.array_join(X.geometry_violations(F.col("numbers"), F.col("m"), {"max_atoms": 6, "min_distance": 5.0, "max_h_per_heavy": 0.4}), ",").alias("violations"))


@query(f"WITH p AS ({_POINTS}) SELECT a.l_orderkey, CAST(a.i - 1 AS INT) AS i, CAST(b.i - 1 AS INT) AS j, round({_DIST}, 6) AS distance FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i WHERE {_DIST} < 8")
def neighbor_list(spark, d):
    e = frames(spark, d).select("l_orderkey", F.posexplode("positions").alias("i", "p"), "positions")
    e = e.select("l_orderkey", "i", "p", F.posexplode("positions").alias("j", "q")).where("i <> j").withColumn("distance", X.distance(F.col("p"), F.col("q")))
    return e.where("distance < 8").select("l_orderkey", "i", "j", F.round("distance", 6).alias("distance"))


@query(f"""WITH p AS ({_POINTS}), c AS (SELECT a.l_orderkey, CASE WHEN a.z = 1 AND b.z = 1 THEN 'HH' WHEN a.z = 1 OR b.z = 1 THEN 'HX' ELSE 'XX' END AS kind, {_DIST} AS x FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.i < b.i)
SELECT l_orderkey, count(*) AS clashes, min(kind) AS first_kind FROM c WHERE x < CASE kind WHEN 'HH' THEN 3 WHEN 'HX' THEN 4 ELSE 5 END GROUP BY 1""")
def clashes(spark, d):
    e = frames(spark, d).select("l_orderkey", F.posexplode(F.arrays_zip("numbers", "positions")).alias("i", "a"), F.arrays_zip("numbers", "positions").alias("z"))
    e = e.select("l_orderkey", "i", "a", F.posexplode("z").alias("j", "b")).where("i < j")
    h = (F.col("a.numbers") == 1).cast("int") + (F.col("b.numbers") == 1).cast("int")
    kind = F.when(h == 2, "HH").when(h == 1, "HX").otherwise("XX")
    floor = F.when(h == 2, 3).when(h == 1, 4).otherwise(5)
    return e.where(X.distance(F.col("a.positions"), F.col("b.positions")) < floor).groupBy("l_orderkey").agg(F.count("*").alias("clashes"), F.min(kind).alias("first_kind"))


@query(f"WITH p AS ({_POINTS}), m AS (SELECT l_orderkey, avg(px) x, avg(py) y, avg(pz) z FROM p GROUP BY 1) SELECT l_orderkey, round(sqrt(avg((px - m.x) ** 2 + (py - m.y) ** 2 + (pz - m.z) ** 2)), 4) AS gyration FROM p JOIN m USING (l_orderkey) GROUP BY 1")
def gyration(spark, d):
    return frames(spark, d).select("l_orderkey", F.round(X.radius_of_gyration(F.col("positions")), 4).alias("gyration"))


@query(f"WITH p AS ({_POINTS}) SELECT CAST(z AS BIGINT) AS element, count(*) AS n FROM p GROUP BY 1")
def atom_species(spark, d):
    return frames(spark, d).select(F.explode("numbers").alias("element")).groupBy(F.col("element").cast("long").alias("element")).agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_POINTS}) SELECT l_orderkey, count(*) FILTER (z NOT IN (1, 6)) AS heteroatoms FROM p GROUP BY 1")
def heteroatoms(spark, d):
    return frames(spark, d).select("l_orderkey", F.size(F.filter("numbers", lambda z: ~z.isin(1, 6))).cast("long").alias("heteroatoms"))


@query(f"WITH p AS ({_POINTS}), s AS (SELECT l_orderkey, max(CASE WHEN z NOT IN (1, 2, 3, 4, 5, 6) THEN 1 ELSE 0 END) AS odd, max(CASE WHEN z = 4 THEN 1 ELSE 0 END) AS metal FROM p GROUP BY 1) SELECT sum(odd)::BIGINT AS outside, sum(metal)::BIGINT AS with_metal, count(*) AS n FROM s")
def domain_check(spark, d):
    odd = F.size(F.array_except(F.array_distinct("numbers"), F.array(*map(F.lit, range(1, 7))))) > 0
    return frames(spark, d).agg(F.count_if(odd).alias("outside"), F.count_if(F.exists("numbers", lambda z: z == 4)).alias("with_metal"), F.count("*").alias("n"))


@query(f"WITH p AS ({_POINTS}) SELECT l_orderkey, list(z ORDER BY i) || list_resize([]::INT[], CAST(ceil(count(*) / 4.0) * 4 - count(*) AS INT), 0) AS padded FROM p GROUP BY 1".replace("list(z ORDER BY i)", "list(CAST(z AS INT) ORDER BY i)"))
def padded_frames(spark, d):
    n = X.pad_length(F.size("numbers"), 4)
    return frames(spark, d).select("l_orderkey", F.concat(F.col("numbers").cast("array<int>"), F.array_repeat(F.lit(0), (n - F.size("numbers")).cast("int"))).alias("padded"))


@query("SELECT l_orderkey, round(exp(-0.5 * ((q - 10) / 5.0) ** 2), 6) AS g10, round(exp(-0.5 * ((q - 30) / 5.0) ** 2), 6) AS g30, round(sqrt(2 / 60.0) * sin(pi() * q / 60) / q, 6) AS b1, round(sqrt(2 / 60.0) * sin(2 * pi() * q / 60) / q, 6) AS b2 FROM (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1)")
def radial_bases(spark, d):
    q = t(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"))
    q = q.select("l_orderkey", X.gaussian(F.col("q"), [10.0, 30.0], 5.0).alias("g"), X.bessel(F.col("q"), 2, 60.0).alias("b"))
    return q.select("l_orderkey", F.round(F.col("g")[0], 6).alias("g10"), F.round(F.col("g")[1], 6).alias("g30"), F.round(F.col("b")[0], 6).alias("b1"), F.round(F.col("b")[1], 6).alias("b2"))


# --- selection ---------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, source, text, n_chars FROM documents WHERE source NOT IN ('src0', 'src1')), pool AS (SELECT DISTINCT text FROM documents WHERE source IN ('src0', 'src1'))
SELECT doc_id, source FROM c WHERE source || ':' || text NOT IN (SELECT source || ':' || text FROM c WHERE text IN (SELECT text FROM pool))""")
def exclude_overlap_exact(spark, d):
    docs = t(spark, d, "documents", "doc_id", "source", "text")
    corpus = docs.where(~F.col("source").isin("src0", "src1")).withColumn("group", F.xxhash64("source", "text"))
    return SE.exclude_overlap(corpus, docs.where(F.col("source").isin("src0", "src1")), "text", "group").select("doc_id", "source")


_KEY = "CASE WHEN n_chars % 3 = 0 THEN 'smiles:' || md5(text) ELSE 'scaffold:' || left(md5(text), 3) END"


@query(f"WITH k AS (SELECT doc_id, source, {_KEY} AS key, n_chars % 50 AS grp FROM documents), c AS (SELECT * FROM k WHERE source NOT IN ('src0', 'src1')), pool AS (SELECT DISTINCT key FROM k WHERE source IN ('src0', 'src1')) SELECT doc_id, key FROM c WHERE grp NOT IN (SELECT grp FROM c WHERE key IN (SELECT key FROM pool) AND key LIKE 'smiles:%')")
def exclude_overlap_key(spark, d):
    docs = t(spark, d, "documents", "doc_id", "source", "text", "n_chars")
    md5 = F.md5(F.col("text").cast("binary"))
    k = docs.select("doc_id", "source", "n_chars", SE.overlap_key(md5, F.when(F.col("n_chars") % 3 != 0, F.substring(md5, 1, 3))).alias("key")).withColumn("grp", F.col("n_chars") % 50)
    pool = k.where(F.col("source").isin("src0", "src1") & F.col("key").startswith("smiles:"))
    return SE.exclude_overlap(k.where(~F.col("source").isin("src0", "src1")), pool, "key", "grp").select("doc_id", "key")


@query("SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 2")
def top_k_per_group(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return SE.top_k_per_group(li, "l_orderkey", "l_extendedprice", 2, descending=True, ties=("l_linenumber", "l_partkey", "l_suppkey"))


@query("SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_quantity >= 10) WHERE rn <= 3")
def top_k_minimum(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return SE.top_k_per_group(li, "l_orderkey", "l_quantity", 3, minimum=10, ties=("l_linenumber", "l_partkey", "l_suppkey"))


_DRAW = "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM {src}) ORDER BY md5('7:0:' || o_custkey), o_custkey LIMIT {n}"


@query("""WITH hit AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), c AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM hit)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM c) WHERE rn = 1),
dr AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM k) ORDER BY md5('7:0:' || o_custkey), o_custkey LIMIT (SELECT CAST(floor(count(DISTINCT o_custkey) * 0.5) AS BIGINT) FROM k))
SELECT o_orderkey, o_custkey FROM k WHERE o_custkey IN (SELECT o_custkey FROM dr)""")
def select_random_nested(spark, d):
    """Overlap exclusion, the best row of each group, then a seeded draw of half the groups."""
    o = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    pool = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    c = SE.exclude_overlap(o, pool, "o_custkey", "o_custkey")
    c = SE.top_k_per_group(c, "o_custkey", "o_totalprice", 1, descending=True, ties=("o_orderkey",))
    return SE.random_groups(c, "o_custkey", 7, fraction=0.5).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (" + _DRAW.format(src="orders", n=40) + ")")
def random_groups_count(spark, d):
    return SE.random_groups(t(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", 7, count=40)


def _hier_sql(w: str) -> str:
    weight = {"equal": "1.0::DOUBLE", "sqrt": "sqrt(n)", "size": "n::DOUBLE"}[w]
    return f"""WITH c AS (SELECT c_custkey, n_regionkey AS coarse, c_nationkey AS fine, md5('3:0:' || c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT *, row_number() OVER (PARTITION BY coarse, fine ORDER BY k, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY coarse, fine) AS n FROM c), b AS (SELECT c_custkey, coarse, k, (r + 1) / {weight} AS tt FROM a),
e AS (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY tt, k, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY coarse) AS n FROM b) SELECT c_custkey FROM e ORDER BY (r + 1) / {weight}, k, c_custkey LIMIT 50"""


def _hier(w: str):
    def run(spark, d):
        c = t(spark, d, "customer", "c_custkey", "c_nationkey").join(F.broadcast(t(spark, d, "nation", "n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        return SE.hierarchical_draw(c, "c_custkey", "n_regionkey", "c_nationkey", 3, 50, w).select("c_custkey")

    run.__name__ = f"hierarchical_draw_{w}"
    return query(_hier_sql(w))(run)


for _w in ("equal", "sqrt", "size"):
    _hier(_w)


@query("SELECT doc_id, substr(md5('5:10:' || doc_id), 1, 13) < '2000000000000' AS held_out FROM documents")
def mixture_holdout(spark, d):
    return t(spark, d, "documents", "doc_id").select("doc_id", SE.holdout("doc_id", 0.125, 5).alias("held_out"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")
def filter_expression(spark, d):
    return SE.where(t(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice > 100000 AND o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")


@query("SELECT 'where' AS step, count(*) AS rows, count(DISTINCT o_custkey) AS groups FROM orders WHERE o_totalprice > 50000 UNION ALL SELECT 'top_k_per_group', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 50000")
def selection_record(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    _, rec = SE.run(o, [("where", {"condition": "o_totalprice > 50000"}), ("top_k_per_group", {"group": "o_custkey", "rank": "o_totalprice", "k": 1, "ties": ("o_orderkey",)})], "o_custkey")
    return spark.createDataFrame([(r["step"], r["rows"], r["groups"]) for r in rec], "step string, rows long, groups long")


# --- preparation -------------------------------------------------------------------------------------------------------


@query("SELECT source, dense_rank() OVER (ORDER BY min(doc_id)) - 1 AS source_id FROM documents GROUP BY source")
def dense_first_seen_ids(spark, d):
    return P.first_seen_ids(t(spark, d, "documents", "doc_id", "source"), "source", "doc_id", "source_id").select("source", F.col("source_id").cast("long").alias("source_id")).distinct()


_VOTE = "v AS (SELECT key, c, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY ALL), w AS (SELECT key, max(n) AS top FROM v GROUP BY 1), b AS (SELECT v.key, count(*) AS k, min(c) AS c FROM v JOIN w ON v.key = w.key AND v.n = w.top GROUP BY 1)"


@query(f"WITH r AS (SELECT md5(text) AS key, doc_id, n_chars::DOUBLE AS y, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 END AS c FROM documents), {_VOTE} SELECT key, min(doc_id) AS first, count(*) AS n, round(avg(y), 6) AS y, any_value(CASE WHEN b.k = 1 THEN b.c END) AS c, coalesce(any_value(b.k > 1), false) AS c_tied FROM r LEFT JOIN b USING (key) GROUP BY 1")
def merge_replicates(spark, d):
    x = t(spark, d, "documents", "doc_id", "text", "n_chars")
    r = x.select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", F.col("n_chars").cast("double").alias("y"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2).alias("c"))
    return P.merge_replicates(r, "key", "doc_id", ["y"], ["c"]).select("key", "first", "n", F.round("y", 6).alias("y"), "c", F.coalesce("c_tied", F.lit(False)).alias("c_tied"))


_REASON = "CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' WHEN rn > 1 THEN 'duplicate' END"


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def row_accounting(spark, d):
    x = t(spark, d, "documents", "doc_id", "text", "n_chars", "lang").withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("h").orderBy("doc_id")))
    reason = X.first_reason(F.when(F.col("n_chars") < 200, "too_short"), F.when(F.col("n_chars") > 20000, "too_long"), F.when(F.col("lang") != "en", "language"), F.when(F.col("rn") > 1, "duplicate"))
    return P.account(x.withColumn("reason", reason), "reason")


@query("SELECT l_partkey, arg_min(s, k) AS label, list_sort(list(DISTINCT s)) AS labels, max(s) * min(s) < 0 AS opposite FROM (SELECT l_partkey, CAST(sign(l_quantity - 25) AS INT) AS s, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey AS k FROM lineitem) GROUP BY 1")
def collapse_entries(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", F.signum(F.col("l_quantity") - 25).cast("int").alias("s"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_suppkey")).alias("k"))
    return P.collapse_entries(li, "l_partkey", "k", "s")


@query("SELECT 'rows' AS item, count(*) AS n FROM orders UNION ALL SELECT 'o_totalprice', count(nullif(o_totalprice > 1e5, false)) FROM orders UNION ALL SELECT 'split:' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def provenance_counts(spark, d):
    o = t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 1e5, F.col("o_totalprice")))
    return P.provenance(o, ["o_totalprice"], "o_orderstatus")


@query("SELECT p_partkey, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS enantiomer_of FROM part WHERE p_partkey % 10 NOT IN (4, 5) UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 10 IN (4, 5)")
def mirror_identity(spark, d):
    p = t(spark, d, "part", "p_partkey")
    meso = (F.col("p_partkey") % 10).isin(4, 5)
    p = p.select("p_partkey", F.concat(F.lit("m"), "p_partkey").alias("form"), F.concat(F.lit("m"), F.when(meso, F.col("p_partkey")).otherwise(F.col("p_partkey").bitwiseXOR(F.lit(1).cast("long")))).alias("mirror"))
    return P.mirror_pairs(p, "p_partkey", "form", "mirror").select("p_partkey", "enantiomer_of")


_BROKEN = "SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 1000000 WHEN p_partkey % 50 = 9 THEN p_partkey WHEN p_partkey % 50 = 11 THEN p_partkey + 3 ELSE xor(p_partkey, 1) END AS partner, CASE WHEN p_partkey % 50 = 20 THEN -1 ELSE p_partkey // 2 END AS mol FROM part"


@query(f"WITH p AS ({_BROKEN}) SELECT a.id, CASE WHEN a.partner = a.id THEN 'self' WHEN b.id IS NULL THEN 'absent' WHEN b.partner IS DISTINCT FROM a.id THEN 'asymmetric' ELSE 'other_molecule' END AS problem FROM p a LEFT JOIN p b ON a.partner = b.id WHERE a.partner = a.id OR b.id IS NULL OR b.partner IS DISTINCT FROM a.id OR a.mol <> b.mol")
def enantiomer_invariants(spark, d):
    k = F.col("p_partkey")
    p = t(spark, d, "part", "p_partkey").select(k.alias("id"), F.when(k % 50 == 7, k + 1000000).when(k % 50 == 9, k).when(k % 50 == 11, k + 3).otherwise(k.bitwiseXOR(F.lit(1).cast("long"))).alias("partner"), F.when(k % 50 == 20, F.lit(-1).cast("long")).otherwise(F.floor(k / 2)).alias("mol"))
    return P.enantiomer_problems(p, "id", "partner", "mol")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS children, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1 AND count(DISTINCT o_orderstatus) > 1")
def straddling_groups(spark, d):
    return P.straddling(t(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "o_orderpriority", "o_orderstatus")


@query("""WITH v AS (SELECT 'charge_missing' AS invariant, CAST(s_suppkey AS VARCHAR) AS key FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'bad_nation', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey > 20),
r AS (SELECT *, row_number() OVER (PARTITION BY invariant ORDER BY key) AS rn FROM v) SELECT invariant, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN key END, ',' ORDER BY key) AS first_keys FROM r GROUP BY 1""")
def invariant_report(spark, d):
    return P.violations(t(spark, d, "supplier"), {"charge_missing": (F.col("s_acctbal") < 0, "s_suppkey"), "bad_nation": (F.col("s_nationkey") > 20, "s_suppkey")})


@query("SELECT 'null' AS problem, count(*) FILTER (c_nationkey IS NULL) AS n FROM customer UNION ALL SELECT 'duplicate', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'fine_in_two_coarse', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)")
def cluster_problems(spark, d):
    return P.cluster_problems(t(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", "c_mktsegment", "c_nationkey")


_KEPT = "SELECT p_partkey AS id, xor(p_partkey, 1) AS partner FROM part WHERE p_size > 10"


@query(f"WITH k AS ({_KEPT}) SELECT id, CASE WHEN partner IN (SELECT id FROM k) THEN partner END AS partner FROM k")
def orphan_rule_null(spark, d):
    k = t(spark, d, "part", "p_partkey", "p_size").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_partkey").bitwiseXOR(F.lit(1).cast("long")).alias("partner"))
    return P.drop_orphans(k, "id", "partner", False)


@query(f"WITH k AS ({_KEPT}) SELECT id, partner FROM k WHERE partner IN (SELECT id FROM k)")
def orphan_rule_drop(spark, d):
    k = t(spark, d, "part", "p_partkey", "p_size").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_partkey").bitwiseXOR(F.lit(1).cast("long")).alias("partner"))
    return P.drop_orphans(k, "id", "partner", True)


@query("WITH a AS (SELECT n_chars % 97 AS k, doc_id, row_number() OVER (PARTITION BY n_chars % 97 ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 3 > 0), b AS (SELECT n_chars % 97 AS k, doc_id, row_number() OVER (PARTITION BY n_chars % 97 ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 3 = 0) SELECT a.k, a.doc_id, b.doc_id AS matched_doc_id FROM a LEFT JOIN b ON a.k = b.k AND a.rn = b.rn")
def multiset_match(spark, d):
    x = t(spark, d, "documents", "doc_id", "n_chars").select((F.col("n_chars") % 97).alias("k"), "doc_id")
    return P.match_multiset(x.where("doc_id % 3 > 0"), x.where("doc_id % 3 = 0"), ["k"], "doc_id")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS old, b.n AS new FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def changed_inputs(spark, d):
    a = t(spark, d, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t(spark, d, "supplier", "s_nationkey").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return P.changed(a, b, "k", "n")


@query("SELECT doc_id, ord FROM (SELECT doc_id, ord, min(ord) OVER (PARTITION BY text) AS f FROM (SELECT doc_id, text, CAST(substr(source, 4) AS INT) AS ord FROM documents)) WHERE f = ord")
def mixture_dedupe(spark, d):
    x = t(spark, d, "documents", "doc_id", "text", "source").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.substring("source", 4, 9).cast("int").alias("ord"))
    return P.dedupe_components(x, "h", "ord").select("doc_id", "ord")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'extra' WHEN b.id IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 > 0) a FULL JOIN (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 > 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def alignment_cover(spark, d):
    p = t(spark, d, "part", "p_partkey").withColumnRenamed("p_partkey", "id")
    return P.cover_problems(p.where("id % 7 > 0"), p.where("id % 11 > 0"), "id")


@query("SELECT text_key, min(doc_id) AS first FROM (SELECT md5(text) AS text_key, doc_id FROM documents WHERE text <> '') GROUP BY 1")
def unique_first_seen(spark, d):
    x = t(spark, d, "documents", "doc_id", "text").where("text <> ''")
    return x.groupBy(F.md5(F.col("text").cast("binary")).alias("text_key")).agg(F.min("doc_id").alias("first"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_of_duplicates(spark, d):
    return P.first_wins(t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("(SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier)")
def shared_keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def rest_rows(spark, d):
    return t(spark, d, "part", "p_partkey").join(t(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("SELECT 'customer' AS dataset, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def tagged_union(spark, d):
    a = t(spark, d, "customer", "c_nationkey").select(F.lit("customer").alias("dataset"), F.col("c_nationkey").alias("k"))
    return a.unionByName(t(spark, d, "supplier", "s_nationkey").select(F.lit("supplier").alias("dataset"), F.col("s_nationkey").alias("k"))).groupBy("dataset", "k").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_nationkey, k.r AS n_regionkey FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey AS r FROM nation WHERE n_nationkey % 6 > 0) k ON c_nationkey = n_nationkey")
def cluster_lookup(spark, d):
    n = t(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_nationkey % 6 > 0")
    return t(spark, d, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_nationkey", "n_regionkey")


# --- splits and draws --------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS i FROM documents GROUP BY 1), c AS (SELECT sum(n)::DOUBLE AS t FROM g),
f AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS source, ''::VARCHAR AS split, 0::DOUBLE AS tr, 0::DOUBLE AS va UNION ALL
SELECT g.i, g.source, CASE WHEN tr + n <= 0.8 * t THEN 'train' WHEN tr + va + n <= 0.9 * t THEN 'valid' ELSE 'test' END, tr + CASE WHEN tr + n <= 0.8 * t THEN n ELSE 0 END, va + CASE WHEN tr + n > 0.8 * t AND tr + va + n <= 0.9 * t THEN n ELSE 0 END FROM f JOIN g ON g.i = f.i + 1, c)
SELECT source, split FROM f WHERE i > 0""")
def scaffold_split(spark, d):
    return SP.group_split(t(spark, d, "documents", "doc_id", "source"), "source", "doc_id")


@query("""WITH RECURSIVE g0 AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT sum(n)::DOUBLE AS t FROM g0), g AS (SELECT source, n, row_number() OVER (ORDER BY CASE WHEN n <= t * 0.1 / 2 THEN 1 ELSE 0 END, md5('11:1:' || source)) AS i FROM g0, c),
f AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS source, ''::VARCHAR AS split, 0::DOUBLE AS tr, 0::DOUBLE AS va UNION ALL
SELECT g.i, g.source, CASE WHEN tr + n <= 0.8 * t THEN 'train' WHEN tr + va + n <= 0.9 * t THEN 'valid' ELSE 'test' END, tr + CASE WHEN tr + n <= 0.8 * t THEN n ELSE 0 END, va + CASE WHEN tr + n > 0.8 * t AND tr + va + n <= 0.9 * t THEN n ELSE 0 END FROM f JOIN g ON g.i = f.i + 1, c)
SELECT source, split FROM f WHERE i > 0""")
def seeded_scaffold_split(spark, d):
    return SP.seeded_group_split(t(spark, d, "documents", "doc_id", "source"), "source", 11)


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey, CASE WHEN r <= round_even(0.1 * n, 0) THEN 'test' WHEN r <= round_even(0.1 * n, 0) + round_even(0.15 * n, 0) THEN 'valid' ELSE 'train' END AS split FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('2:2:' || p_partkey), p_partkey) AS r FROM part), n")
def random_split(spark, d):
    return SP.random_split(t(spark, d, "part", "p_partkey"), "p_partkey", 2, 0.1, 0.15)


@query("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS test, bool_or(o_orderstatus = 'P') AND NOT bool_and(o_orderstatus = 'P') AS straddles FROM orders GROUP BY 1")
def assign_test_fold(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderstatus").withColumn("split", F.when(F.col("o_orderstatus") == "P", "test").otherwise("train"))
    return SP.any_member_test(o, "o_custkey", "split")


@query()
def length_batches(spark, d):
    return SP.length_batches(t(spark, d, "documents", "doc_id", "n_chars"), F.floor(F.col("doc_id") / 1000), "doc_id", "n_chars", 200_000)


@query("SELECT vec_id, round(x, 5) AS norm FROM (SELECT vec_id, sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in embedding])) AS x FROM embeddings) ORDER BY x DESC, vec_id LIMIT 20")
def norm_top_n(spark, d):
    e = t(spark, d, "embeddings", "vec_id", "embedding").withColumn("norm", X.norm(F.col("embedding")))
    return e.orderBy(F.desc("norm"), "vec_id").limit(20).select("vec_id", F.round("norm", 5).alias("norm"))


@query("SELECT vec_id FROM embeddings ORDER BY md5('9:3:' || vec_id), vec_id LIMIT 64")
def reservoir(spark, d):
    """Bottom k of a hash: a uniform sample that merges."""
    return t(spark, d, "embeddings", "vec_id").orderBy(SE.draw_key(9, 3, "vec_id"), "vec_id").limit(64)


@query("WITH top AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 3), a AS (SELECT vec_id FROM embeddings WHERE label IN (SELECT label FROM top) ORDER BY md5('4:4:' || vec_id), vec_id LIMIT 50), b AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM a) ORDER BY md5('4:5:' || vec_id), vec_id LIMIT 50) SELECT vec_id FROM a UNION ALL SELECT vec_id FROM b")
def stratified_sample(spark, d):
    e = t(spark, d, "embeddings", "vec_id", "label")
    top = e.groupBy("label").count().orderBy(F.desc("count"), "label").limit(3)
    a = e.join(top, "label", "left_semi").orderBy(SE.draw_key(4, 4, "vec_id"), "vec_id").limit(50).select("vec_id")
    return a.unionByName(e.join(a, "vec_id", "left_anti").orderBy(SE.draw_key(4, 5, "vec_id"), "vec_id").limit(50).select("vec_id"))


# --- statistics --------------------------------------------------------------------------------------------------------

_NUMS = ("p_size", "p_retailprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS label, count({c}) AS n, round(count({c}) * 1.0 / count(*), 6) AS coverage, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS p{round(100 * q):02d}' for q in ST.QUANTILES)} FROM part" for c in _NUMS))
def distribution_stats(spark, d):
    return ST.distribution(t(spark, d, "part", *_NUMS), list(_NUMS)).select("label", "n", *r6("coverage", "mean", "std"), "min", "max", *r6(*[f"p{round(100 * q):02d}" for q in ST.QUANTILES]))


@query("SELECT k AS label, count(v) AS n, round(count(v) * 1.0 / count(*), 6) AS coverage FROM (SELECT 'quality' AS k, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', nullif(toxic, 0) FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def target_coverage(spark, d):
    x = t(spark, d, "documents", "doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("quality", F.nullif("toxic", F.lit(0)).alias("toxic"))
    return ST.distribution(x, ["quality", "toxic"]).select("label", "n", F.round("coverage", 6).alias("coverage"))


@query("SELECT round(avg(CASE WHEN p_size <= 20 AND p_retailprice < 1500 THEN 1 ELSE 0 END), 6) AS lipinski_share FROM part")
def lipinski_share(spark, d):
    ok = (F.coalesce("p_size", F.lit(0)) <= 20) & (F.coalesce("p_retailprice", F.lit(0)) < 1500)
    return t(spark, d, "part", "p_size", "p_retailprice").agg(F.round(F.avg(ok.cast("int")), 6).alias("lipinski_share"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def top_categories(spark, d):
    return t(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


_EXP = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings)"


@query(f"WITH {_EXP}, r AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1), b AS (SELECT dim, least(floor((x - lo) / (hi - lo) * 16), 15) AS b, count(*) AS n FROM e JOIN r USING (dim) GROUP BY 1, 2), p AS (SELECT dim, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY dim) AS p FROM b) SELECT CAST(dim AS INT) AS dim, round(sum(-p * log2(p)), 5) AS bits FROM p GROUP BY 1")
def capacity_entropy(spark, d):
    return ST.marginal_entropy(t(spark, d, "embeddings", "embedding"), "embedding", 16).select("dim", F.round("bits", 5).alias("bits"))


@query(f"WITH {_EXP}, m AS (SELECT dim, avg(x) AS m FROM e GROUP BY 1), z AS (SELECT vec_id, dim, x - m AS z FROM e JOIN m USING (dim)), c AS (SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) / ((SELECT count(*) FROM embeddings) - 1) AS c FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN c END) ** 2 / sum(CASE WHEN i = j THEN 1 ELSE 2 END * c * c), 4) AS participation_ratio, round(sum(CASE WHEN i = j THEN c END), 4) AS trace FROM c")
def participation_ratio(spark, d):
    return ST.participation_ratio(ST.covariance(t(spark, d, "embeddings", "embedding"), "embedding")).select(F.round("participation_ratio", 4).alias("participation_ratio"), F.round("trace", 4).alias("trace"))


@query(f"WITH {_EXP} SELECT round(avg(abs(r)), 5) AS mean_abs_correlation FROM (SELECT corr(a.x, b.x) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.dim, b.dim)")
def mean_abs_correlation(spark, d):
    return ST.mean_abs_correlation(ST.covariance(t(spark, d, "embeddings", "embedding"), "embedding")).select(F.round("mean_abs_correlation", 5).alias("mean_abs_correlation"))


@query()
def covariance_spectrum(spark, d):
    c = ST.covariance(t(spark, d, "embeddings", "embedding"), "embedding")
    return spark.createDataFrame(ST.spectrum(c), "rank int, eigenvalue double, explained double")


@query()
def coding_rate(spark, d):
    return spark.createDataFrame([(ST.coding_rate(ST.covariance(t(spark, d, "embeddings", "embedding"), "embedding")),)], "bits double")


@query(f"WITH {_EXP} SELECT CAST(dim AS INT) AS dim, round(avg(x), 5) AS mean, round(CASE WHEN stddev_samp(x) < 1e-6 THEN 1 ELSE stddev_samp(x) END, 5) AS std, count(*) AS n FROM e GROUP BY 1")
def descriptor_statistics(spark, d):
    e = ST.components_of(t(spark, d, "embeddings", "embedding"), "embedding").groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("n"))
    return e.select("dim", F.round("mean", 5).alias("mean"), F.round(F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")), 5).alias("std"), "n")


@query("WITH x AS (SELECT sqrt(list_sum([v::DOUBLE * v::DOUBLE for v in embedding])) AS x FROM embeddings) SELECT count(*) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(quantile_cont(x, 0.5), 5) AS median FROM x")
def norm_distribution(spark, d):
    e = t(spark, d, "embeddings", "embedding").select(X.norm(F.col("embedding")).alias("x"))
    return e.agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"), F.round(F.percentile("x", F.lit(0.5)), 5).alias("median"))


@query(f"WITH {_EXP}, m AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1), z AS (SELECT vec_id, dim, (x - m) / (s + 1e-12) AS z FROM e JOIN m USING (dim)), n AS (SELECT vec_id, sqrt(sum(z * z)) + 1e-12 AS n FROM z GROUP BY 1) SELECT z.vec_id, round(sum(z / n * (dim + 1)), 3) AS checksum FROM z JOIN n USING (vec_id) GROUP BY 1")
def z_l2_normalise(spark, d):
    e = t(spark, d, "embeddings", "vec_id", "embedding")
    m = ST.components_of(e, "embedding").groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("a"))
    z = e.join(F.broadcast(m)).select("vec_id", X.z_score(F.col("embedding"), F.col("a.m"), F.col("a.s")).alias("z"))
    u = z.select("vec_id", "z", X.norm(F.col("z")).alias("n"))
    return u.select("vec_id", F.round(F.aggregate(F.transform("z", lambda v, i: v / (F.col("n") + 1e-12) * (i + 1)), F.lit(0.0), lambda a, v: a + v), 3).alias("checksum"))


@query(f"WITH {_EXP} SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 5) AS m FROM e GROUP BY 1, 2")
def mean_pool(spark, d):
    p = ST.pooled(t(spark, d, "embeddings", "label", "embedding"), "label", "embedding")
    return p.select("label", F.posexplode("mean").alias("dim", "m")).select("label", "dim", F.round("m", 5).alias("m"))


@query(f"WITH {_EXP} SELECT CASE WHEN dim < 16 THEN 'a' ELSE 'b' END AS layer, round(avg(x), 6) AS mean, round(var_samp(x), 5) AS var FROM e GROUP BY 1")
def layer_slices(spark, d):
    e = t(spark, d, "embeddings", "embedding")
    parts = [e.select(F.lit(k).alias("layer"), F.explode(F.slice("embedding", a + 1, b - a).cast("array<double>")).alias("x")) for k, a, b in (("a", 0, 16), ("b", 16, 64))]
    return parts[0].unionByName(parts[1]).groupBy("layer").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_samp("x"), 5).alias("var"))


@query("SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency(spark, d):
    return ST.contingency(t(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")


@query("WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), d AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c, t), s AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM d) SELECT round(mi, 8) AS mi, round(mi / ((ha + hb) / 2), 8) AS nmi FROM s")
def mutual_info(spark, d):
    return ST.mutual_information(ST.contingency(t(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")).select(F.round("mi", 8).alias("mi"), F.round("nmi", 8).alias("nmi"))


@query()
def adjusted_mutual_info(spark, d):
    c = ST.contingency(t(spark, d, "customer", "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey")
    return spark.createDataFrame([(ST.adjusted_mutual_information(c),)], "ami double")


@query("WITH n AS (SELECT p_brand, nullif(p_size % 6, 5) AS l, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY p_brand) AS p FROM n WHERE l IS NOT NULL), m AS (SELECT p_brand, sum(n)::BIGINT AS members FROM n GROUP BY 1) SELECT p_brand, any_value(members) AS members, sum(n)::BIGINT AS resolved, arg_max(l, n * 100 + l) AS modal, round(max(p), 6) AS purity, round(sum(-p * log2(p)), 6) AS bits FROM k JOIN m USING (p_brand) GROUP BY 1")
def modal_entropy(spark, d):
    p = t(spark, d, "part", "p_brand", "p_size").withColumn("l", F.nullif(F.col("p_size") % 6, F.lit(5)))
    return ST.purity(p, "p_brand", "l").select("p_brand", "members", "resolved", "modal", *r6("purity", "bits"))


@query("WITH n AS (SELECT p_brand, nullif(p_size % 6, 5) AS l, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY p_brand) AS p FROM n WHERE l IS NOT NULL), m AS (SELECT p_brand, sum(n) AS members FROM n GROUP BY 1), q AS (SELECT p_brand, max(p) AS p FROM k GROUP BY 1) SELECT round(sum(members * p) / sum(members), 6) AS purity FROM q JOIN m USING (p_brand)")
def weighted_purity(spark, d):
    p = t(spark, d, "part", "p_brand", "p_size").withColumn("l", F.nullif(F.col("p_size") % 6, F.lit(5)))
    return ST.weighted_purity(p, "p_brand", "l").select(F.round("purity", 6).alias("purity"))


@query("WITH s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS clusters, round(avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 6) AS singletons, quantile_cont(n, 0.5)::DOUBLE AS median, round(quantile_cont(n, 0.9), 6) AS q90, round(quantile_cont(n, 0.99), 6) AS q99, max(n) AS largest FROM s")
def cluster_size_summary(spark, d):
    s = t(spark, d, "lineitem", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    s = s.agg(F.count("*").alias("clusters"), F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("singletons"), q.alias("q"), F.max("n").alias("largest"))
    return s.select("clusters", "singletons", F.col("q")[0].alias("median"), F.round(F.col("q")[1], 6).alias("q90"), F.round(F.col("q")[2], 6).alias("q99"), "largest")


@query("WITH k AS (SELECT DISTINCT lang AS a, source || ':' || n_chars % 50 AS k FROM documents), s AS (SELECT a, count(*) AS n FROM k GROUP BY 1) SELECT x.a, y.a AS b, coalesce(c.n, 0) AS both, round(coalesce(c.n, 0) * 1.0 / (x.n + y.n - coalesce(c.n, 0)), 6) AS jaccard FROM s x JOIN s y ON x.a < y.a LEFT JOIN (SELECT p.a, q.a AS b, count(*) AS n FROM k p JOIN k q ON p.k = q.k AND p.a < q.a GROUP BY 1, 2) c ON c.a = x.a AND c.b = y.a")
def scaffold_jaccard(spark, d):
    x = t(spark, d, "documents", "lang", "source", "n_chars").select("lang", F.concat_ws(":", "source", F.col("n_chars") % 50).alias("key"))
    return ST.pairwise_jaccard(x, "lang", "key").select("a", "b", "both", F.round("jaccard", 6).alias("jaccard"))


@query("WITH k AS (SELECT n_chars % 128 AS bit, count(*)::DOUBLE AS k FROM (SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id, doc_id * 7 FROM documents) GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT round(sum(k * (k - 1) / 2) / sum(k * (k - 1) / 2 + k * (n - k)), 8) AS isim FROM k, n")
def isim_calibration(spark, d):
    x = t(spark, d, "documents", "doc_id", "n_chars").select(F.array(F.col("n_chars") % 128, F.col("doc_id") * 7 % 128).alias("bits"))
    return ST.isim(x, "bits", 128).select(F.round("isim", 8).alias("isim"))


@query("WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(max(CASE WHEN l_linestatus = 'F' THEN q END), 6) AS \"F\", round(max(CASE WHEN l_linestatus = 'O' THEN q END), 6) AS \"O\" FROM m GROUP BY 1")
def panel_pivot(spark, d):
    p = t(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return p.select("l_returnflag", *r6("F", "O"))


@query("WITH m AS (SELECT l_returnflag, l_suppkey, sum(round(l_quantity)) AS q FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY q DESC) + (count(*) OVER (PARTITION BY l_returnflag, q) - 1) / 2.0::DOUBLE AS rank FROM m")
def panel_rank(spark, d):
    m = t(spark, d, "lineitem", "l_returnflag", "l_suppkey", "l_quantity").groupBy("l_returnflag", "l_suppkey").agg(F.sum(F.round("l_quantity")).alias("q"))
    return m.select("l_returnflag", "l_suppkey", M.average_rank(-F.col("q"), "l_returnflag").alias("rank"))


@query("WITH s AS (SELECT label AS cluster, vec_id % 4 AS axis FROM embeddings), n AS (SELECT cluster, axis, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT cluster, sum(n) AS t FROM n GROUP BY 1) SELECT cluster, arg_max(axis, n * 10 - axis) AS best, round(max(n) * 1.0::DOUBLE / any_value(t), 6) AS share FROM n JOIN t USING (cluster) GROUP BY 1")
def axis_winner(spark, d):
    n = t(spark, d, "embeddings", "vec_id", "label").groupBy(F.col("label").alias("cluster"), (F.col("vec_id") % 4).alias("axis")).agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.max_by("axis", F.struct("n", -F.col("axis"))).alias("best"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


# --- similarity --------------------------------------------------------------------------------------------------------


_BITS = "list_distinct([('0x' || substr(md5(w), 1, 4))::INT % 4096 for w in string_split(text, ' ')])"


@query(f"""WITH b AS (SELECT item_id, {_BITS} AS x FROM benchmark), q AS (SELECT doc_id, {_BITS} AS y FROM documents WHERE doc_id % 100 = 0)
SELECT doc_id, round(max(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))), 6) AS nearest FROM q, b GROUP BY 1""")
def nn_tanimoto(spark, d):
    """A search: the stated queries against every reference item, whose packed bits come in blocks of a size of their own."""
    fp = X.word_bits(F.col("text"), 64)
    q = t(spark, d, "documents", "doc_id", "text").where("doc_id % 100 = 0").select("doc_id", fp.alias("y"))
    ref = t(spark, d, "benchmark", "item_id", "text").select(fp.alias("x"), F.pmod(F.xxhash64("item_id"), F.lit(64)).alias("block")).groupBy("block").agg(F.collect_list("x").alias("xs"))
    each = q.join(ref).select("doc_id", F.array_max(F.transform("xs", lambda x: X.tanimoto(x, F.col("y")))).alias("s"))
    return each.groupBy("doc_id").agg(F.round(F.max("s"), 6).alias("nearest"))


@query("WITH m AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings), v AS (SELECT label, dim, avg(x) AS x FROM m GROUP BY 1, 2) SELECT a.label AS i, b.label AS j, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 4) AS cosine FROM v a JOIN v b ON a.dim = b.dim AND a.label <= b.label GROUP BY 1, 2")
def cosine_matrix(spark, d):
    p = ST.pooled(t(spark, d, "embeddings", "label", "embedding"), "label", "embedding")
    a, b = p.select(F.col("label").alias("i"), F.col("mean").alias("u")), p.select(F.col("label").alias("j"), F.col("mean").alias("v"))
    return a.join(F.broadcast(b), F.col("i") <= F.col("j")).select("i", "j", F.round(X.cosine(F.col("u"), F.col("v")), 4).alias("cosine"))


@query()
def leader_clusters(spark, d):
    """Clusters on neighbour pairs within a label (cosine of 0.6 or more).  Of equal vectors of a label the smallest id stands for
    all: they are neighbours of the same others, so they go where it goes."""
    e = t(spark, d, "embeddings", "vec_id", "label", "embedding")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    fit = F.coalesce(F.col("label").isNotNull() & (length > 0) & (length < float("inf")), F.lit(False))
    own = e.where(fit)
    alike = own.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w"))
    led = L.leader_clusters(L.near_pairs(alike, "vec_id", "label", "embedding", 0.6), alike, "vec_id", "w").withColumnRenamed("vec_id", "first")
    members = own.join(alike.select("label", "embedding", F.col("vec_id").alias("first")), ["label", "embedding"]).select("first", "vec_id")
    return led.join(members, "first").select("leader", "vec_id").unionByName(e.where(~fit).select(F.col("vec_id").alias("leader"), "vec_id"))


# --- metrics and learners ----------------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT doc_id, quality AS y, toxic AS tx, (n_chars % 1000)::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    x = t(spark, d, "documents", "doc_id", "n_chars", "lang").join(t(spark, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", F.col("quality").alias("y"), F.col("toxic").alias("tx"), (F.col("n_chars") % 1000).cast("double").alias("p"))


_AUROC = "WITH {src}, r AS (SELECT {k} y, rank() OVER ({w} ORDER BY p) + (count(*) OVER (PARTITION BY {pk} p) - 1) / 2.0::DOUBLE AS r FROM s), a AS (SELECT {k} sum(r * y) AS sr, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM r {g}) "


@query(_AUROC.format(src=_SCORED, k="", w="", pk="", g="") + "SELECT round((sr - n1 * (n1 + 1) / 2) / (n1 * n0), 8) AS auroc FROM a")
def auroc(spark, d):
    return M.auroc(_scored(spark, d), [], "y", "p").select(F.round("auroc", 8).alias("auroc"))


@query(f"WITH {_SCORED}, v AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS pr FROM v) SELECT round(sum(pos * pr) / sum(pos), 8) AS auprc FROM c")
def auprc(spark, d):
    return M.auprc(_scored(spark, d), [], "y", "p").select(F.round("auprc", 8).alias("auprc"))


@query("WITH s AS (SELECT l.label, CASE l.label WHEN 'y' THEN quality ELSE toxic END AS y, (n_chars % 1000)::DOUBLE AS p FROM documents JOIN labels USING (doc_id), (VALUES ('y'), ('tx')) l(label)), " + _AUROC.format(src="x AS (SELECT 1)", k="label, ", w="PARTITION BY label", pk="label, ", g="GROUP BY label").removeprefix("WITH x AS (SELECT 1), ") + ", u AS (SELECT (sr - n1 * (n1 + 1) / 2) / (n1 * n0) AS u FROM a) SELECT round(avg(u), 8) AS macro_auroc, count(u) AS n_labels FROM u")
def macro_auroc(spark, d):
    long = _scored(spark, d).select("doc_id", "p", "y", "tx").unpivot(["doc_id", "p"], ["y", "tx"], "label", "v")
    return M.macro_auroc(long, "label", "v", "p").select(F.round("macro_auroc", 8).alias("macro_auroc"), "n_labels")


@query("SELECT p_brand, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 5) AS r2 FROM (SELECT p_brand, p_retailprice AS y, p_size * 30.0::DOUBLE AS p FROM part) GROUP BY 1")
def regression_metrics(spark, d):
    x = t(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("y"), (F.col("p_size") * F.lit(30.0)).alias("p"))
    return M.regression(x, ["p_brand"], "y", "p").select("p_brand", "n", *[F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2")])


@query("WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman(spark, d):
    return M.spearman(t(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", F.round("spearman", 6).alias("spearman"))


_PRED = "SELECT label AS y, (label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS p FROM embeddings"


def _pred(spark, d):
    return t(spark, d, "embeddings", "vec_id", "label").select("vec_id", F.col("label").alias("y"), ((F.col("label") + (F.col("vec_id") % 3 == 0).cast("int")) % 10).alias("p"))


_REPORT = f"WITH s AS ({_PRED}), c AS (SELECT unnest(range(12))::INT AS class), a AS (SELECT class, (SELECT count(*) FROM s WHERE y = class AND p = class) AS hit, (SELECT count(*) FROM s WHERE y = class) AS support, (SELECT count(*) FROM s WHERE p = class) AS called FROM c), m AS (SELECT class, CASE WHEN called > 0 THEN hit / called::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall, support, called FROM a), z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m) "


@query(_REPORT + "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, called FROM z")
def multiclass_report(spark, d):
    return M.multiclass_report(_pred(spark, d), "y", "p", 12).select("class", *r6("precision", "recall", "f1"), "support", "called")


@query(_REPORT + "SELECT round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy, round(avg(CASE WHEN support > 0 OR called > 0 THEN f1 END), 6) AS macro_f1 FROM z")
def balanced_accuracy(spark, d):
    return M.balanced(_pred(spark, d), "y", "p", 12).select(*r6("balanced_accuracy", "macro_f1"))


@query(f"WITH s AS ({_PRED}) SELECT y AS true, p AS predicted, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY y))::DOUBLE, 6) AS share FROM s GROUP BY 1, 2")
def confusion_rows(spark, d):
    return M.row_normalised(M.confusion(_pred(spark, d), "y", "p")).select("true", "predicted", "n", F.round("share", 6).alias("share"))


@query("WITH s AS (SELECT k AS class, CASE WHEN label = k THEN 1 ELSE 0 END AS y, embedding[k + 1]::DOUBLE AS p FROM embeddings, (SELECT unnest(range(10))::INT AS k)), " + _AUROC.format(src="x AS (SELECT 1)", k="class, ", w="PARTITION BY class", pk="class, ", g="GROUP BY class").removeprefix("WITH x AS (SELECT 1), ") + "SELECT class, round(CASE WHEN n1 > 0 AND n0 > 0 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * n0) END, 6) AS auroc FROM a")
def one_vs_rest(spark, d):
    e = t(spark, d, "embeddings", "label", "embedding").select("label", *[F.col("embedding")[i].alias(f"s{i}") for i in range(10)])
    return M.one_vs_rest(e, "label", [f"s{i}" for i in range(10)]).select("class", F.round("auroc", 6).alias("auroc"))


@query("WITH m AS (SELECT l_partkey AS id, xor(l_partkey, 1) AS o, avg(round(l_quantity)) AS y, avg(l_linenumber) AS p FROM lineitem GROUP BY 1) SELECT round(avg(CASE WHEN a.p = b.p THEN 0.5 WHEN (a.p > b.p) = (a.y > b.y) THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS pairs FROM m a JOIN m b ON a.o = b.id AND a.id < b.id WHERE a.y <> b.y")
def pair_ranking(spark, d):
    li = t(spark, d, "lineitem", "l_partkey", "l_quantity", "l_linenumber").select(F.col("l_partkey").alias("id"), F.col("l_partkey").bitwiseXOR(F.lit(1).cast("long")).alias("o"), F.round("l_quantity").alias("y"), F.col("l_linenumber").alias("p"))
    return M.pair_ranking(li, "id", "o", "y", "p").select(F.round("accuracy", 6).alias("accuracy"), "pairs")


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS prediction FROM part GROUP BY 1")
def null_learner(spark, d):
    return L.null_learner(t(spark, d, "part", "p_brand", "p_retailprice"), "p_retailprice", ["p_brand"]).select("p_brand", F.round("prediction", 6).alias("prediction"))


@query()
def ridge_predictions(spark, d):
    e = t(spark, d, "embeddings", "vec_id", "label", "embedding").select("vec_id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)])
    x = [f"x{i}" for i in range(8)]
    return e.select("vec_id", F.round(L.linear(x, *L.ridge(e, x, "y")), 6).alias("prediction"))


@query("WITH n AS (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT unnest(range(12))::INT AS class), w AS (SELECT class, coalesce((SELECT count(*) FROM embeddings)::DOUBLE / (12 * n), 1) AS raw FROM c LEFT JOIN n USING (class)) SELECT class, round(raw / avg(raw) OVER (), 6) AS weight FROM w")
def class_weights(spark, d):
    return L.class_weights(t(spark, d, "embeddings", "label"), "label", 12).select("class", F.round("weight", 6).alias("weight"))


@query("SELECT p_brand, round(sum(CASE WHEN y IS NOT NULL THEN (y - p) * (y - p) ELSE 0 END) / greatest(count(y), 1), 4) AS masked_mse, round(avg(-0.25 * (1 - q) ** 2 * ln(q)), 6) AS focal FROM (SELECT p_brand, nullif(p_retailprice, 901.0) AS y, p_size * 30.0::DOUBLE AS p, (p_size + 1) / 60.0::DOUBLE AS q FROM part) GROUP BY 1")
def losses(spark, d):
    p = t(spark, d, "part").select("p_brand", F.nullif("p_retailprice", F.lit(901.0)).alias("y"), (F.col("p_size") * F.lit(30.0)).alias("p"), ((F.col("p_size") + 1) / F.lit(60.0)).alias("q"))
    e = F.pow(F.col("y") - F.col("p"), 2)
    return p.groupBy("p_brand").agg(F.round(F.coalesce(F.sum(e), F.lit(0.0)) / F.greatest(F.count("y"), F.lit(1)), 4).alias("masked_mse"), F.round(F.avg(-0.25 * F.pow(1 - F.col("q"), 2) * F.ln("q")), 6).alias("focal"))


@query("SELECT s AS step, round(CASE WHEN s < 10 THEN (s + 1) / 10.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((s - 10) / 90.0::DOUBLE, 1.0))) END, 8) AS rate FROM (SELECT unnest(range(120)) AS s)")
def learning_rate(spark, d):
    return spark.range(120).select(F.col("id").alias("step"), F.round(X.warm_up_then_decay(F.col("id"), 10, 100, 0.1), 8).alias("rate"))


@query("SELECT event_id // 100 AS \"window\", count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events GROUP BY 1")
def telemetry_windows(spark, d):
    w = ST_F.count_windows(t(spark, d, "events", "event_id", "value"), "event_id", 100, "value")
    return w.select("window", "n", *r6("mean_value", "max_value"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round((SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS c FROM events) WHERE r = greatest(CAST(floor(0.95 * c) AS BIGINT), 1)), 6) AS p95 FROM events")
def loader_waits(spark, d):
    e = t(spark, d, "events", "value")
    n = e.count()
    q = (max(math.floor(0.95 * n), 1) - 1) / max(n - 1, 1)  # the k-th smallest, as a quantile
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(q)), 6).alias("p95"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS train, count(*) FILTER (o_orderstatus = 'O') AS valid, count(*) FILTER (o_orderstatus = 'P') AS test FROM orders GROUP BY 1")
def split_counts(spark, d):
    c = t(spark, d, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return c.select("o_custkey", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("F", "train"), ("O", "valid"), ("P", "test"))])


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'central' WHEN 'MACHINERY' THEN 'axial' WHEN 'HOUSEHOLD' THEN 'planar' ELSE 'other' END AS class FROM customer")
def normalised_classes(spark, d):
    s = F.lower(F.trim("c_mktsegment"))
    return t(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", F.when(s == "building", "central").when(s == "machinery", "axial").when(s == "household", "planar").otherwise("other").alias("class"))


from . import catalog_records  # noqa: E402,F401  registers more of them
