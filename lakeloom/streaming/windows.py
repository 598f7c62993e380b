"""Event-time windows for batches and streams: the same plan serves both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by tumbling (or, with slide, hopping) windows; late is the watermark of a stream."""
    source = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and df.isStreaming:
        source = source.withWatermark(ts, late)
    out = source.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    source = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and df.isStreaming:
        source = source.withWatermark(ts, late)
    out = source.groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *(c for c in out.columns if c != "session_window"))
