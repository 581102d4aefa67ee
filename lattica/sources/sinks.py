"""Sinks: staged writes that are complete or absent, with a manifest last."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, order: list[str]) -> str:
    """Of the rows in the order given; -0.0 counts as 0.0.  Rows are hashed where they are, then 64-character hashes are
    chained by blocks of the order key, so no task holds the table."""
    cells = [F.coalesce((F.col(c) + F.lit(0.0)).cast("string") if t in ("double", "float") else F.col(c).cast("string"), F.lit("\u0001")) for c, t in df.dtypes]
    names = F.lit(",".join(f"{c}:{t}" for c, t in df.dtypes))
    key = F.xxhash64(*order)
    rows = df.select(F.sha2(F.concat_ws("\u0002", names, F.to_json(F.struct(*order)), *cells), 256).alias("h"), F.pmod(key, F.lit(4096)).alias("b"))
    blocks = rows.groupBy("b").agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.sum(F.conv(F.substring("h", 13, 12), 16, 10).cast("decimal(38,0)")).alias("t"), F.count("*").alias("n"))
    got = blocks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "s", "t", "n"))), ","), 256).alias("h")).first()
    return got.h


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bundle(df: DataFrame, path: str, order: list[str], replace: bool = False, sort: bool = True) -> dict:
    """Write beside the target, then rename; the manifest goes in before the rename, so a bundle has it or isn't there."""
    spark = df.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if sort else df).write.parquet(f"{staging}/table")
    written = spark.read.parquet(f"{staging}/table")
    record = {"rows": written.count(), "hash": content_hash(written, order), "columns": dict(written.dtypes)}
    p, _ = _fs(spark, f"{staging}/manifest.json")
    out = fs.create(p)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    old = None
    if fs.exists(target):
        old, _ = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
        fs.rename(target, old)
    try:
        if not fs.rename(_fs(spark, staging)[0], target):
            raise OSError(f"can't rename to {path}")
    except Exception:
        if old:
            fs.rename(old, target)
        raise
    if old:
        fs.delete(old, True)
    return record


def read_bundle(spark, path: str, order: list[str], verify: bool = True) -> DataFrame:
    record = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    df = spark.read.parquet(f"{path}/table")
    if verify and content_hash(df, order) != record["hash"]:
        raise ValueError(f"{path}: the table isn't the one its manifest was written for")
    return df


def write_rows(df: DataFrame, path: str, form: str = "csv") -> None:
    """Tables as csv or json lines; refuses to overwrite."""
    w = df.write.mode("errorifexists")
    w.csv(path, header=True) if form == "csv" else w.json(path)


def extended_xyz(df: DataFrame, symbols: str, positions: str, comment: str) -> DataFrame:
    """One text block a row: number of atoms, comment, then a line for each atom."""
    atoms = F.zip_with(symbols, positions, lambda s, p: F.format_string("%s %.6f %.6f %.6f", s, p["x"], p["y"], p["z"]))
    return df.select(F.concat_ws("\n", F.size(symbols).cast("string"), F.col(comment), F.array_join(atoms, "\n")).alias("value"))
