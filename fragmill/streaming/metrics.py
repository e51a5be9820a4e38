"""Streams: stateless row operators run unchanged in micro-batches; metrics are kept in windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_metrics(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, keys, n, mean): counts and means over non-null values in each window; rows later than ``late`` are dropped
    by the watermark. On a batch DataFrame it gives the complete windows."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = events.withWatermark(time, late).groupBy(w.alias("w"), *keys)
    ready = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.nanvl(value, F.lit(None).cast("double"))).alias("mean"))
    return ready.select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): activity closer together than ``gap``."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_in_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through ``transform`` into a folder of its number, which a replay overwrites: exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
