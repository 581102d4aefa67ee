"""Incremental forms: restartable shards and count windows.  Event-time windows are an extension of ours."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def process_shards(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each batch of new files is a shard, written once: its folder is named by the batch and replaced if it is retried."""
    def put(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/shard={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_windows(df: DataFrame, step: str, size: int, *values: str) -> DataFrame:
    """Tumbling windows of steps: n, means and maxima."""
    return df.groupBy(F.floor(F.col(step) / size).alias("window")).agg(F.count("*").alias("n"), *[f(v).alias(f"{k}_{v}") for v in values for k, f in (("mean", F.avg), ("max", F.max))])


def event_windows(df: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Extension: tumbling event-time windows with a watermark; the same on batches and streams."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
