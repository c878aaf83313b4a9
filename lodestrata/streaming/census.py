"""A windowed census over an unbounded table of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_census(events: DataFrame, time: str, label: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, label, n) of each time window; works on batch and streaming frames alike."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = stamped.groupBy(F.window("_t", size).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "label", "n")
