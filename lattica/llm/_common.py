"""Reading tables, staging intermediate tables on shared storage, small column helpers."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Whether a query's shuffled files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A local session (tests) that names none gets one, gone when it ends; on a
    cluster that is an error, as executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stage(df: DataFrame, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.  With ``release`` the files
    that were shuffled for it go as soon as it is written, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(x) with value computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bitmap(ids: DataFrame, column: str = "doc_id", bits: int = 1 << 24) -> np.ndarray:
    """A bitmap with the bit ``id mod bits`` of every id: 2 MB, however many there are.  Ids whose bit is 0 are surely none."""
    rows = ids.selectExpr(f"pmod({column}, {bits}) AS at").selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in rows.toLocalIterator():
        out[r.w] = r.b
    return out


def in_bitmap(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = np.mod(ids, 64 * len(bitmap))
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1
