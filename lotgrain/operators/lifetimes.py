"""Lives of a listing: alive from the first sighting until a silent period longer than the gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_SECONDS = 7 * 24 * 60 * 60


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def number_islands(
    intervals: DataFrame, key: str, start: str, end: str, gap_micros: int, into: str = "life"
) -> DataFrame:
    """Number the runs of intervals per key that are no further apart than the gap.

    A distance of exactly the gap still joins. Intervals may overlap.
    """
    ordered = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    is_new = F.coalesce(F.col(start) - reached > gap_micros, F.lit(True)).cast("int")
    marked = intervals.withColumn("_new", is_new)
    running = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(into, running).drop("_new")


def fold_sightings(
    sightings: DataFrame, key: str, seen_at: str, gap_micros: int, extra: Sequence[Column] = ()
) -> DataFrame:
    """Pre-aggregate to one row per key and time slot of the gap's width.

    Rows of one slot are less than a gap apart and so belong to one life. This runs before
    any shuffle by key, so a key with a third of all rows shrinks to its number of slots.
    """
    us = sightings.withColumn("_us", micros(seen_at))
    slot = F.floor(F.col("_us") / gap_micros)
    return us.groupBy(key, slot.alias("_slot")).agg(
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.count(F.lit(1)).alias("sightings"),
        *extra,
    )


def lifetimes(
    sightings: DataFrame, key: str = "ad_number", seen_at: str = "seen_at", gap_seconds: int = WEEK_SECONDS
) -> DataFrame:
    """One row per life: ``createdAt``, ``updatedAt``, ``expiresAt`` and the number of sightings."""
    gap = gap_seconds * 1_000_000
    slots = fold_sightings(sightings, key, seen_at, gap)
    lives = number_islands(slots, key, "first_us", "last_us", gap).groupBy(key, "life").agg(
        F.min("first_us").alias("_from"),
        F.max("last_us").alias("_to"),
        F.sum("sightings").alias("sightings"),
    )
    return lives.select(
        key,
        F.timestamp_micros("_from").alias("createdAt"),
        F.timestamp_micros("_to").alias("updatedAt"),
        F.timestamp_micros(F.col("_to") + F.lit(gap)).alias("expiresAt"),
        "sightings",
    )
