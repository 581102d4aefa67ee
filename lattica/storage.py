"""Intermediate tables in the shared folder of the session."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """Write and read back; the folder is spark.checkpoint.dir, or for a local session without one a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
