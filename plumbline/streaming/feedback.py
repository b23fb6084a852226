"""Structured Streaming for feedback: one record per id, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_records(stream: DataFrame, ts_col: str = "received_at", delay: str = "1 day") -> DataFrame:
    """The first delivery of each id within the delay; state older than that is dropped by the watermark."""
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["id"])


def counts(stream: DataFrame, ts_col: str = "received_at", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Records per window and kind."""
    return stream.withWatermark(ts_col, delay).groupBy(F.window(ts_col, width), "kind").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "kind", "n"
    )


def append_new(stream: DataFrame, path: str, checkpoint: str):
    """Write unique records to a parquet folder; the checkpoint makes restarts exact."""
    return unique_records(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
