"""Grouping of listings by make, model and year.

Three forms, by how much they carry:

* ``group_summary``: one row per group with counts and ranges; partial aggregation on the map
  side, so a group with a third of all rows costs no more than the others.
* ``group_rows``: one row per listing with its group's counts; nothing is gathered.
* ``group_members``: nested arrays. A group of usual size is one row; a larger one comes as
  several rows (``chunk`` 0, 1, ...) in member order, so no task and no row has to hold it whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrain.schema import MEMBER_FIELDS, REQUIRED_MEMBER_FIELDS

GROUP_KEYS = ("make", "model", "year")
# Rows per array; a chunk stays below about four times this.
CHUNK_ROWS = 10_000
# Width of the ranges of a number that is ordered over all rows.
RANGE_WIDTH = 1024


def check_keys(keys: Sequence[str]) -> list[str]:
    """Distinct group keys in the order given; anything but make, model and year is refused."""
    bad = [k for k in keys if k not in GROUP_KEYS]
    if bad:
        raise ValueError(f"cannot group by {bad}; valid keys are {list(GROUP_KEYS)}")
    return list(dict.fromkeys(keys))


def is_valid_member() -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in REQUIRED_MEMBER_FIELDS])


def with_member_id(listings: DataFrame) -> DataFrame:
    """Add the stringified key ``id`` unless the table has one."""
    if "id" in listings.columns:
        return listings.withColumn("id", F.col("id").cast("string"))
    return listings.withColumn("id", F.col("ad_number").cast("string"))


def group_counts(listings: DataFrame, keys: Sequence[str], min_count: int = 1) -> DataFrame:
    """Keys, ``count`` and ``valid_count`` of the groups that reach the threshold."""
    keys = check_keys(keys)
    counted = listings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_valid_member()).alias("valid_count")
    )
    # Without keys Spark returns a row even for no input; no rows means no group.
    return counted.where(F.col("count") >= max(min_count, 1))


def group_summary(
    listings: DataFrame, keys: Sequence[str], min_count: int = 1, image_by: str | None = None
) -> DataFrame:
    """Counts and the year and price ranges per group.

    With ``image_by`` (a unique number, such as the ad number) also ``img_src`` of the member
    that has the lowest one.
    """
    keys = check_keys(keys)
    sums = [
        F.count(F.lit(1)).alias("count"),
        F.count_if(is_valid_member()).alias("valid_count"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    ]
    if image_by:
        # Settled in the same aggregation: one partial row per group and task is shuffled, and
        # the listings themselves are neither moved nor read again.
        sums.append(F.min_by("img_src", image_by).alias("img_src"))
    return listings.groupBy(*keys).agg(*sums).where(F.col("count") >= max(min_count, 1))


def group_image(listings: DataFrame, keys: Sequence[str], order: str = "ad_number") -> DataFrame:
    """Keys and ``img_src`` of the first member by a unique number."""
    return group_summary(listings, keys, image_by=order).select(*check_keys(keys), "img_src")


def order_groups(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest groups first, ties by key."""
    return groups.orderBy(F.desc("count"), *check_keys(keys))


def _with_total(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of the one group without keys, as a scalar subquery; no group, no rows."""
    total = counts.select(F.struct("count", "valid_count").alias("t")).scalar()
    named = rows.withColumn("_t", total).where(F.col("_t").isNotNull())
    return named.select(
        *rows.columns, F.col("_t.count").alias("count"), F.col("_t.valid_count").alias("valid_count")
    )


def group_rows(listings: DataFrame, keys: Sequence[str], min_count: int = 1) -> DataFrame:
    """Flat members: the nine projected fields of every listing whose group reaches the
    threshold, with the group's counts."""
    keys = check_keys(keys)
    members = with_member_id(listings).select(*MEMBER_FIELDS)
    members = members.withColumn("valid", is_valid_member())
    counts = group_counts(listings, keys, min_count)
    if not keys:
        return _with_total(members, counts)
    renamed = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "count", "valid_count")
    on = reduce(and_, [members[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return members.join(renamed, on).drop(*[f"_{k}" for k in keys])


def chunk_plan(
    rows: DataFrame, keys: Sequence[str], order: str, valid: Column, min_count: int = 1, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Where each order value of each group goes: ``_base`` chunk and number of ``_splits``.

    Works on a histogram (one row per group and order value), so it never sees single rows; the
    group's ``count`` and ``valid_count`` are sums over it, and groups below ``min_count`` have
    no place. Values share a chunk until it is full; a value that alone exceeds a chunk is split.
    """
    sizes = rows.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_v"))

    def before(*by: str, of: str) -> Column:
        earlier = Window.partitionBy(*by).orderBy(F.col(of).asc_nulls_first())
        return F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    whole = Window.partitionBy(*keys)
    counts = [F.sum("_n").over(whole).alias("count"), F.sum("_v").over(whole).alias("valid_count")]
    if keys:
        starts = sizes.select("*", before(*keys, of=order).alias("_start"), *counts)
    else:
        # One group for all rows: sums within ranges of the order first, then over the ranges'
        # totals, so that no task sees more than a range or one row per range.
        ranged = sizes.withColumn("_range", F.floor(F.col(order) / RANGE_WIDTH))
        totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
        offsets = totals.select(F.col("_range").alias("_r"), before(of="_range").alias("_offset"), *counts)
        # The condition keeps both sides' histograms the same, so Spark makes one.
        inner = ranged.where("_v >= 0").withColumn("_inner", before("_range", of=order))
        starts = inner.join(offsets, F.col("_range").eqNullSafe(F.col("_r"))).withColumn("_start", F.col("_inner") + F.col("_offset"))
    return starts.where(F.col("count") >= max(min_count, 1)).select(
        *keys,
        order,
        "count",
        "valid_count",
        F.floor(F.col("_start") / chunk_rows).alias("_base"),
        F.greatest(F.floor(F.col("_n") / chunk_rows), F.lit(1)).alias("_splits"),
    )


def gather_in_chunks(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    element: Column,
    into: str,
    valid: Column,
    min_count: int = 1,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Arrays of ``element`` per group and ``chunk``, every row in exactly one array.

    Inside a chunk the order is (order, tie); chunk numbers grow with ``order`` and may have
    gaps. A group of up to ``chunk_rows`` rows has the single chunk 0; one below ``min_count``
    is left out before its rows move. ``count`` and ``valid_count`` are those of the group. A
    value that is split is dealt out by all columns of its rows, so equal or null ties do not meet.
    """
    keys = list(keys)
    plan = chunk_plan(rows, keys, order, valid, min_count, chunk_rows)
    names = [*keys, order]
    counts = ["count", "valid_count"]
    plan = plan.select(*[F.col(n).alias(f"_p_{n}") for n in names], *counts, "_base", "_splits")
    on = reduce(and_, [rows[n].eqNullSafe(plan[f"_p_{n}"]) for n in names])
    share = F.pmod(F.xxhash64(*rows.columns), F.col("_splits"))
    placed = rows.join(plan, on).withColumn("chunk", F.col("_base") + share)
    item = F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), element.alias("e"))
    gathered = placed.groupBy(*keys, *counts, "chunk").agg(F.sort_array(F.collect_list(item)).alias(into))
    return gathered.withColumn(into, F.transform(into, lambda x: x["e"]))


def group_members(
    listings: DataFrame,
    keys: Sequence[str],
    min_count: int = 1,
    sort_by: str = "year",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Groups with their members as ``cars``, sorted by year or price.

    A listing that lacks a required field stays as a null element and counts. Only the nine
    projected fields are read, not whole records.
    """
    if sort_by not in ("year", "price"):
        raise ValueError("members are sorted by year or price")
    keys = check_keys(keys)
    members = with_member_id(listings).select(*MEMBER_FIELDS)
    car = F.when(is_valid_member(), F.struct(*MEMBER_FIELDS))
    arrays = gather_in_chunks(members, keys, sort_by, "id", car, "cars", is_valid_member(), min_count, chunk_rows)
    return arrays.select(*keys, "count", "valid_count", "chunk", "cars")


def makes_models(
    listings: DataFrame, make: str = "make", model: str = "model", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Distinct models per make, sorted.

    Duplicates fall away before anything is gathered. A make with more models than a chunk
    holds comes as several rows; each is sorted by itself.
    """
    pairs = listings.select(F.col(make).alias("make"), F.col(model).alias("model")).distinct()
    sizes = pairs.groupBy("make").agg(F.count("model").alias("_n"))
    sizes = sizes.select(
        F.col("make").alias("_make"),
        F.greatest(F.ceil(F.col("_n") / chunk_rows), F.lit(1)).alias("_splits"),
    )
    placed = pairs.join(sizes, pairs["make"].eqNullSafe(sizes["_make"]))
    chunk = F.pmod(F.xxhash64("model"), F.col("_splits"))
    return placed.groupBy("make", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list("model")).alias("models")
    )
