"""Summaries that keep up with a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from econspark.operators.describe import summarize
from econspark.schema import as_list, number


def stream_summarize(stream: DataFrame, cols=None, by=None) -> DataFrame:
    """N, mean, sd, min, max per column over everything seen so far (``complete`` or ``update`` mode).

    The state is one row of mergeable aggregates per group, whatever the length of the stream.
    """
    return summarize(stream, cols, by)


def windowed_summarize(
    stream: DataFrame, value: str, ts: str, window: str = "1 hour", slide: str | None = None, by=None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """N, mean, sd, min, max of ``value`` per event-time window and key.

    Rows later than ``watermark`` are dropped and closed windows leave the state, so ``append`` mode
    works and memory stays bounded.
    """
    v = number(stream, value)
    slot = F.window(ts, window, slide) if slide else F.window(ts, window)
    keys = as_list(by)
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(slot.alias("window"), *[F.col(f"`{k}`") for k in keys])
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "mean", "sd", "min", "max")
    )


def write_available(result: DataFrame, mode: str, checkpoint: str) -> DataStreamWriter:
    """Writer that processes what is there and stops; give it a format and start it."""
    return result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
