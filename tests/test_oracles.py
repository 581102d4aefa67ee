"""Every query of the library proper against its SQL."""
import os

import duckdb
import pytest

from lattica import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((str([r[c] for c in columns]) for r in df.collect()))
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    rel = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert rows == sorted(str([r[i] for i in order]) for r in rel.fetchall())


def test_least_distances_of_odd_rows(spark, tmp_path):
    """Null keys, null and NaN coordinates, infinite ones, ties in the SQL's order and single rows."""
    n, i = float("nan"), float("inf")
    own = [(1, 1, 2.0, 0.01, 0.0), (1, 2, None, 0.01, 0.0), (2, 1, None, 0.0, 0.0), (2, 2, None, 0.0, 0.0), (3, 1, n, 0.0, 0.0), (3, 2, 1.0, 0.0, 0.0), (4, 1, n, 0.0, 0.0), (4, 2, 1.0, 0.0, 0.0), (4, 3, 4.0, 0.01, 0.0)]
    own += [(None, 1, 1.0, 0.0, 0.0), (None, 2, 3.0, 0.0, 0.0), (5, 1, i, 0.0, 0.0), (5, 2, i, 0.0, 0.0), (6, 1, i, 0.0, 0.0), (6, 2, 1.0, 0.0, 0.0), (7, 1, 1.0, 0.0, 0.0), (8, 1, 1.0, 0.01, 0.0), (8, 1, 1.0, 0.05, 0.0), (8, 1, 1.0, 0.09, 0.02)]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(own, columns).selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1.0D AS l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(str, c.sql(catalog.ORACLE_SQL["min_distance"]).fetchall())) == sorted(str(tuple(r)) for r in catalog.QUERIES["min_distance"](spark, str(tmp_path)).collect())
