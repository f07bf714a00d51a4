"""Point density over a stream: counts per coarse cell and time window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_density(points: DataFrame, cell: float, window: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """(start, cx, cy, n) of a stream of points (x, y, ts); rows later than `late` don't count."""
    at = points.withWatermark(time, late)
    grouped = at.groupBy(F.window(time, window), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "cx", "cy", "n")
