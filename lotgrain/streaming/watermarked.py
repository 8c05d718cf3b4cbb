"""Stateful forms that need no snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(sightings: DataFrame, key: str = "ad_number", seen_at: str = "seen_at", delay: str = "7 days") -> DataFrame:
    """One row per ad: repeats within the watermark delay are dropped."""
    timed = sightings.withColumn(seen_at, F.col(seen_at).cast("timestamp"))
    return timed.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([key])


def ended_lives(
    sightings: DataFrame, key: str = "ad_number", seen_at: str = "seen_at",
    gap: str = "7 days", lateness: str = "1 day",
) -> DataFrame:
    """Lives as session windows; in append mode a life comes out once it can no longer grow."""
    timed = sightings.withColumn(seen_at, F.col(seen_at).cast("timestamp"))
    windowed = timed.withWatermark(seen_at, lateness).groupBy(
        key, F.session_window(seen_at, gap).alias("life")
    )
    return windowed.agg(F.max(seen_at).alias("updatedAt"), F.count(F.lit(1)).alias("sightings")).select(
        key,
        F.col("life.start").alias("createdAt"),
        "updatedAt",
        F.col("life.end").alias("expiresAt"),
        "sightings",
    )
