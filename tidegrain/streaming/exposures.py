"""An extension, not a reference feature: an arriving daily exposure feed against static weights and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(feed: DataFrame, weights: DataFrame, column: str, late: str = "7 days") -> DataFrame:
    """feed(ts, unit, column) -> running (episode_id, day) weighted sums that gridded plans read; late rows up to `late`."""
    met = feed.withWatermark("ts", late).join(F.broadcast(weights) if not weights.isStreaming and weights.limit(100_001).count() <= 100_000 else weights, "unit")
    return met.groupBy("episode_id", F.window("ts", "1 day").alias("day")).agg(F.sum(F.col(column) * F.col("weight")).alias("weighted"), F.sum(F.when(F.col(column).isNotNull(), F.col("weight"))).alias("weight"))
