"""Scans.  Columns are pruned and filters pushed by Catalyst; NaN, the missing value of float sources, becomes NULL here."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def table_row_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def table_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def read_ordered_csvs(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files in order of priority; file_ord and the line's byte-order key within the file keep the source order."""
    parts = [spark.read.schema(schema).option("mode", "FAILFAST").csv(p, header=True).withColumn("file_ord", F.lit(i)).withColumn("pos", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    if (found := df.count()) != n:
        raise ValueError(f"expected {n} rows, found {found}")
    return df


def numeric_or_null(c: str) -> Column:
    """The number a text holds, NULL if none."""
    return F.expr(f"try_cast({c} AS DOUBLE)")


def decode_one_hot(hot: Column, alphabet: list[int]) -> Column:
    """Rows of a one-hot matrix to symbols; all-zero rows are padding."""
    table = F.array(*map(F.lit, alphabet))
    return F.filter(F.transform(hot, lambda r: F.get(table, (F.array_position(r, 1.0) - 1).cast("int"))), lambda x: x.isNotNull())


def read_embeddings(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Rows with their checks: right size, all components finite."""
    d = spark.read.parquet(path)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.withColumn("ok", (F.size("embedding") == dim) & finite)


def discover(spark: SparkSession, root: str, marker: str, recursive: bool = True) -> list[str]:
    """Sorted folders under root that hold the marker file; by Hadoop's file system, so any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [(path, 0)]
    while todo:
        at, depth = todo.pop()
        for s in fs.listStatus(at):
            if s.isDirectory() and (recursive or depth == 0):
                todo.append((s.getPath(), depth + 1))
            elif s.getPath().getName() == marker:
                out.append(at.toString().removeprefix("file:"))
    return sorted(out)


def ensure_pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, if the file's content has the hash."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if not found or found.h != sha256:
        raise ValueError(f"{path} has hash {found.h if found else None}, not {sha256}")
    return path


def sha256_of_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an xyz text, apart by blank lines: comment fields as a map, numbers of atoms and lines."""
    d = spark.read.text(path, lineSep="\n\n").select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\n").alias("lines")).where(F.get("lines", F.lit(0)) != "")
    fields = F.call_function("str_to_map", F.get("lines", F.lit(1)), F.lit("\\|"), F.lit("="))
    return d.select(F.get("lines", F.lit(0)).cast("int").alias("n_atoms"), fields.alias("fields"), F.slice("lines", 3, 1 << 30).alias("atoms"))
