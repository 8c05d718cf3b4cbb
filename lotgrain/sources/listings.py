"""Listing tables, lookups and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrain.schema import LISTINGS, LOOKUPS


def read_listings(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Stored listings, all or those that match; the condition reaches the parquet scan."""
    rows = spark.read.schema(LISTINGS).parquet(path)
    return rows if where is None else rows.where(where)


def write_listings(listings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet clustered by make and model, so their row-group statistics prune filters."""
    clustered = listings.repartitionByRange("make", "model").sortWithinPartitions("make", "model", "year")
    clustered.write.mode(mode).parquet(path)


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Lookup table from a CSV with the header ``domain,key,value``."""
    return spark.read.schema(LOOKUPS).option("header", True).csv(path)


def group_json(groups: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row, in the column ``json``; null fields are left out."""
    return groups.select(F.to_json(F.struct(*(columns or groups.columns))).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one group or make per line, written by all tasks."""
    rows.write.mode(mode).json(path)
