"""Incremental sufficient statistics of a point stream (the batch operators as streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_centroids(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Centroids and counts of clusters in tumbling windows; rows later than `late` are dropped by
    the watermark, which also bounds the state. stream: time, cluster, x, y."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "cluster", "cx", "cy", "n")
