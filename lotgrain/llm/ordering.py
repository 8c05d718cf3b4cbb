"""Rows in one order over all partitions, and their places within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrain.llm.rows import written

#: ``at`` holds the partition in its upper bits and the row within it in so many lower ones.
ROW_BITS = 33


def in_order(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``at``, a number that grows along the order (nulls first), written.

    Rows are dealt by ranges of the whole order, so a group that holds many rows spreads over
    many tasks.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.withColumn("at", F.monotonically_increasing_id()), name)


def with_places(rows: DataFrame, group: str) -> DataFrame:
    """Rows of ``in_order``, whose order begins with ``group`` (never null), with ``pos`` from 0 and ``size`` of the group.

    Only one count for each group and partition is summed up: a group has as many as it has partitions.
    """
    part = F.shiftright("at", ROW_BITS).alias("part")
    runs = rows.groupBy(group, part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "first", F.sum("n").over(whole).alias("size"))
    placed = rows.withColumn("part", part).join(runs, [group, "part"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "before", "first", "at")
