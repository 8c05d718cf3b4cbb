"""Keeping one current record per ad: upsert, refresh, expiry and the joins around them.

Which row of a key counts is settled on numbers alone, in hash maps on the map side; only the
chosen rows are then brought together, so a key seen a billion times costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "ad_number"
RETENTION_DAYS = 7


def duplicate_keys(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once; empty when the table is sound."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def _place(rows: DataFrame, order: Sequence[str]) -> Column:
    """The place of a row in one or two columns of time or whole numbers, as one decimal.

    A decimal lies in a fixed slot of an aggregation buffer, so its maximum is kept in a hash
    map, which a struct would not be. The first of two columns may reach 4e18 in size (any
    time does); nulls come first.
    """
    types = dict(rows.dtypes)

    def number(name: str) -> Column:
        timed = types[name].startswith(("timestamp", "date"))
        whole = F.unix_micros(F.col(name).cast("timestamp")) if timed else F.col(name).cast("bigint")
        return whole.cast("decimal(19,0)")

    if len(order) == 1:
        return F.coalesce(number(order[0]), F.lit(Decimal(-(2**63)))).cast("decimal(38,0)")
    if len(order) != 2:
        raise ValueError(f"one or two columns give the order, not {len(order)}")
    first = F.coalesce(number(order[0]), F.lit(Decimal(-4 * 10**18)))
    second = F.coalesce(number(order[1]) + F.lit(Decimal(2**63)), F.lit(Decimal(-1)))
    return (first * F.lit(Decimal(2 * 10**19)) + second).cast("decimal(38,0)")


def _edge(rows: DataFrame, key: str, order: Sequence[str], last: bool = True) -> DataFrame:
    """``_key`` and ``_at``, the place of its last (or first) row: numbers only, in hash maps."""
    place = _place(rows, order)
    return rows.groupBy(F.col(key).alias("_key")).agg((F.max(place) if last else F.min(place)).alias("_at"))


def _rows_at(rows: DataFrame, edge: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows at the places of ``edge``, one per key.

    Rows meet their edge by key and place, so the rows of a hot key go to many tasks and only
    what stays is brought together. Of several rows at one place a hash of all columns decides.
    """
    at = F.col(key).eqNullSafe(F.col("_key")) & (_place(rows, order) == F.col("_at"))
    kept = rows.join(edge, at, "left_semi")
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return kept.groupBy(key).agg(F.max_by(whole, F.xxhash64(*rows.columns)).alias("_row")).select("_row.*")


def latest_per_key(rows: DataFrame, key: str = KEY, order: Sequence[str] = ("updatedAt",)) -> DataFrame:
    """One whole row per key: the last by ``order``, one or two columns of time or whole numbers."""
    return _rows_at(rows, _edge(rows, key, order), key, order)


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str = KEY, order: Sequence[str] = ("updatedAt",)
) -> DataFrame:
    """Replace whole records by key and insert the absent ones."""
    newest = latest_per_key(incoming, key, order)
    untouched = stored.join(newest.select(key), key, "left_anti")
    return untouched.unionByName(newest, allowMissingColumns=True).select(*stored.columns)


def last_sightings(
    sightings: DataFrame, key: str = KEY, order: Sequence[str] = ("seen_at", "seq"), link: str = "ad_link"
) -> DataFrame:
    """Key, link and time of the last sighting of every ad."""
    narrow = sightings.select(*dict.fromkeys([key, link, *order]))
    return latest_per_key(narrow, key, order).select(key, F.col(link).alias("_link"), F.col(order[0]).alias("_seen"))


def refresh(
    stored: DataFrame,
    sightings: DataFrame,
    key: str = KEY,
    order: Sequence[str] = ("seen_at", "seq"),
    link: str = "ad_link",
    updated: str = "updatedAt",
) -> DataFrame:
    """Set link and update time of stored ads that were seen; nothing is inserted.

    A sighting older than the stored update time changes nothing.
    """
    last = last_sightings(sightings, key, order, link)
    joined = stored.join(last, key, "left")
    hit = F.col("_seen").isNotNull() & (F.col(updated).isNull() | (F.col("_seen") >= F.col(updated)))
    changed = {
        link: F.when(hit, F.col("_link")).otherwise(F.col(link)),
        updated: F.when(hit, F.col("_seen")).otherwise(F.col(updated)),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns])


def not_expired(
    as_of: datetime | Column, days: float = RETENTION_DAYS, updated: str = "updatedAt"
) -> Column:
    """Kept while updated within the period; records without a date never expire."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    oldest = now - F.make_dt_interval(secs=F.lit(days * 86400.0))
    return F.col(updated).isNull() | (F.col(updated) >= oldest)


def retain(
    stored: DataFrame, as_of: datetime | Column, days: float = RETENTION_DAYS, updated: str = "updatedAt"
) -> DataFrame:
    return stored.where(not_expired(as_of, days, updated))


def first_sightings(
    sightings: DataFrame, key: str = KEY, order: Sequence[str] = ("seen_at", "seq")
) -> DataFrame:
    """The first sighting of every ad, as a whole row."""
    return _rows_at(sightings, _edge(sightings, key, order, last=False), key, order)


def new_ads(
    sightings: DataFrame, stored: DataFrame, key: str = KEY, order: Sequence[str] = ("seen_at", "seq")
) -> DataFrame:
    """Ads that are not stored yet, each with its first sighting."""
    known = stored.select(F.col(key).alias("_key"))
    edge = _edge(sightings, key, order, last=False).join(known, "_key", "left_anti")
    return _rows_at(sightings, edge, key, order)


def known_ads(
    sightings: DataFrame, stored: DataFrame, key: str = KEY, order: Sequence[str] = ("seen_at", "seq")
) -> DataFrame:
    """Ads that are stored already, each with its last sighting."""
    known = stored.select(F.col(key).alias("_key"))
    edge = _edge(sightings, key, order).join(known, "_key", "left_semi")
    return _rows_at(sightings, edge, key, order)


def merge_short_and_details(
    short: DataFrame, details: DataFrame, short_key: str = KEY, details_key: str = "sighted_number"
) -> DataFrame:
    """One record from result-page and ad-page data; the ad page's own number wins.

    ``short`` has number, ``ad_link`` and ``img_link``; ``details`` names the number it was
    looked up under in ``details_key``. A difference is flagged in ``number_mismatch``.
    """
    side = short.select(
        F.col(short_key).alias("_sighted"),
        F.col("ad_link").alias("link"),
        F.col("img_link").alias("img_src"),
    )
    joined = details.drop("link", "img_src").join(side, F.col(details_key) == F.col("_sighted"))
    rest = [c for c in details.columns if c not in (details_key, "link", "img_src")]
    mismatch = F.coalesce(F.col(KEY) != F.col("_sighted"), F.lit(True))
    return joined.select("link", "img_src", *rest, mismatch.alias("number_mismatch"))


def outcome_counts(rows: DataFrame, by: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Inserted, failed and refreshed ads per page or run; ``attempted`` is inserted + failed."""

    def times(value: str) -> Column:
        amount = F.col("n") if "n" in rows.columns else F.lit(1)
        return F.sum(F.when(F.col(outcome) == value, amount).otherwise(F.lit(0)))

    return (
        rows.groupBy(*by)
        .agg(
            times("inserted").alias("inserted"),
            times("failed").alias("failed"),
            times("refreshed").alias("refreshed"),
        )
        .withColumn("attempted", F.col("inserted") + F.col("failed"))
    )


def run_totals(
    page_stats: DataFrame, run: str = "run_id", page: str = "page_id", total: str | None = None
) -> DataFrame:
    """Pages read, ads attempted and inserted, and the announced total, per run."""
    sums = [
        F.countDistinct(page).alias("pages"),
        F.sum("attempted").alias("attempted"),
        F.sum("inserted").alias("inserted"),
        F.sum("refreshed").alias("refreshed"),
    ]
    if total:
        sums.append(F.max(total).alias("total_ads"))
    return page_stats.groupBy(run).agg(*sums)
