"""One batch of sightings against the stored listings.

Within a batch an ad's first sighting inserts it and later ones refresh it. An ad that was
silent for longer than the retention period starts a new life and must be parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrain.functions.urls import ad_number
from lotgrain.operators.joins import MAX_KEY_ROWS, MAX_WIDE_ROWS, broadcast_if_small
from lotgrain.operators.lifetimes import WEEK_SECONDS, fold_sightings, micros, number_islands
from lotgrain.operators.upkeep import KEY, latest_per_key
from lotgrain.plans.extraction import ad_page_listings, page_ads
from lotgrain.schema import LISTINGS
from lotgrain.sources.snapshots import bucket_of


def page_sightings(result_pages: DataFrame) -> DataFrame:
    """The ads on result pages as sightings; ``parse_error`` is empty for the usable ones.

    ``seq`` orders the ads of a whole run: page number first, place on the page second.
    """
    seq = F.col("page_no").cast("bigint") * F.lit(1_000_000) + F.col("seq")
    return page_ads(result_pages).select(
        KEY, "ad_link", "img_link", "page_id", "url", seq.alias("seq"), "seen_at", "parse_error"
    )


def bucketed_ad_pages(pages: DataFrame, buckets: int) -> DataFrame:
    """Ad pages with their number and its bucket, the form to write ``partitionBy("bucket")``."""
    number = ad_number(F.col("url"))
    return pages.select("page_id", "url", "html", number.alias(KEY), bucket_of(number, buckets).alias("bucket"))


def ad_page_details(
    ad_pages: DataFrame, wanted: DataFrame, buckets: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Typed records of the ad pages of the wanted ads, one per ad.

    Which page counts (the one with the highest ``page_id``) is settled on numbers alone;
    only those pages are then moved and parsed. With ``buckets`` the pages are a table of
    ``bucketed_ad_pages`` written by bucket, and a few wanted ads read only their buckets.
    ``at_most`` is a bound of the number of wanted ads, if known.
    """
    by = ["sighted_number"] if buckets is None else ["sighted_number", "bucket"]
    keys = wanted.select(F.col(KEY).alias("sighted_number"))
    if buckets is not None:
        # The comparison tells Spark that this side is worth pruning the buckets by.
        keys = keys.withColumn("bucket", bucket_of(F.col("sighted_number"), buckets)).where(F.col("bucket") >= 0)
    few = (at_most is not None and at_most <= MAX_KEY_ROWS) or wanted.count() <= MAX_KEY_ROWS
    number = ad_number(F.col("url")) if buckets is None else F.col(KEY)
    numbered = ad_pages.select("page_id", number.alias("sighted_number"), *by[1:])
    numbered = numbered.join(F.broadcast(keys) if few else keys, by, "left_semi")
    chosen = numbered.groupBy(*by).agg(F.max("page_id").alias("page_id"))
    # One page per wanted ad, so the count bounds this side too and pages stay where they are.
    pages = ad_pages.select("page_id", "url", "html", *by[1:])
    pages = pages.join(F.broadcast(chosen) if few else chosen, ["page_id", *by[1:]]).drop("bucket")
    return ad_page_listings(pages).dropDuplicates(["sighted_number"])


def current_lives(
    sightings: DataFrame, stored: DataFrame, gap_seconds: float = WEEK_SECONDS
) -> DataFrame:
    """The last life of every sighted ad, over its stored dates and its sightings.

    Gives the key, ``is_stored``, ``sightings``, the first sighting of that life (``first``:
    link, image, page) and its last link with its time.
    """
    gap = round(gap_seconds * 1_000_000)
    at = F.struct("_us", "seq")
    seen = fold_sightings(
        sightings,
        KEY,
        "seen_at",
        gap,
        [
            F.min_by(F.struct("ad_link", "img_link", "page_id"), at).alias("first"),
            F.max_by(F.struct(F.col("_us").alias("us"), F.col("ad_link").alias("link")), at).alias("last"),
        ],
    ).drop("_slot")
    sighted = seen.select(KEY).distinct()
    dates = stored.join(sighted, KEY, "left_semi").select(
        KEY,
        micros("createdAt").alias("first_us"),
        micros("updatedAt").alias("last_us"),
        F.lit(0).cast("bigint").alias("sightings"),
        F.lit(True).alias("is_stored"),
    )
    both = seen.withColumn("is_stored", F.lit(False)).unionByName(dates, allowMissingColumns=True)
    lives = number_islands(both, KEY, "first_us", "last_us", gap)
    per_life = lives.groupBy(KEY, "life").agg(
        F.max("is_stored").alias("is_stored"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sum("sightings").alias("sightings"),
        # The earliest slot that has sightings, and the latest.
        F.min_by("first", F.when(F.col("sightings") > 0, F.col("first_us"))).alias("first"),
        F.max_by("last", F.when(F.col("sightings") > 0, F.col("last_us"))).alias("last"),
    )
    rest = [c for c in per_life.columns if c not in (KEY, "life")]
    last_life = per_life.groupBy(KEY).agg(F.max_by(F.struct(*rest), "life").alias("_l"))
    return last_life.select(KEY, "_l.*")


def unstored(lives: DataFrame) -> DataFrame:
    """Ads whose current life has no stored record, so their page must be parsed."""
    return lives.where(~F.col("is_stored"))


def changed_rows(
    lives: DataFrame, stored: DataFrame, details: DataFrame, at_most: int | None = None
) -> DataFrame:
    """Records to write, with ``outcome``, ``first_page`` and ``sightings``.

    ``outcome`` is ``inserted``, ``refreshed`` or ``failed`` (no usable ad page; such rows
    carry the sighted number only and are not stored). ``details`` has ``sighted_number``,
    ``ad_number``, ``parse_error`` and listing columns. ``at_most`` bounds the number of lives,
    if known.
    """
    columns = LISTINGS.fieldNames()
    common = ["sighted_number", "sightings", "first_page", "first_link", "parse_error", "number_mismatch"]
    known = lives.where(F.col("is_stored") & (F.col("sightings") > 0)).withColumnRenamed(KEY, "_key")
    known = broadcast_if_small(known, MAX_WIDE_ROWS, at_most)
    is_later = F.coalesce(F.col("last.us") >= micros("updatedAt"), F.lit(True))
    set_on_refresh = {
        "ad_link": F.when(is_later, F.col("last.link")).otherwise(F.col("ad_link")),
        "updatedAt": F.when(is_later, F.timestamp_micros("last.us")).otherwise(F.col("updatedAt")),
    }
    refreshed = stored.join(known, stored[KEY] == known["_key"]).select(
        *[set_on_refresh.get(c, F.col(c)).alias(c) for c in columns],
        F.col("_key").alias("sighted_number"),
        "sightings",
        F.col("first.page_id").alias("first_page"),
        F.col("first.ad_link").alias("first_link"),
        F.array().cast("array<string>").alias("parse_error"),
        F.lit(False).alias("number_mismatch"),
        F.lit("refreshed").alias("outcome"),
    )

    made_here = {"link", "img_src", "ad_link", "createdAt", "updatedAt"}
    parsed = details.select(
        F.col("sighted_number").alias("_sighted"),
        "parse_error",
        *[F.col(c) for c in columns if c not in made_here and c in details.columns],
    )
    fresh = unstored(lives).withColumnRenamed(KEY, "sighted_number")
    joined = fresh.join(parsed, F.col("sighted_number") == F.col("_sighted"), "left")
    errors = F.coalesce("parse_error", F.array(F.lit("ad_page")))
    usable = F.size(errors) == 0
    set_on_insert: dict[str, Column] = {
        "link": F.col("first.ad_link"),
        "img_src": F.col("first.img_link"),
        "ad_link": F.when(F.col("sightings") > 1, F.col("last.link")),
        "createdAt": F.timestamp_micros("first_us"),
        "updatedAt": F.timestamp_micros("last_us"),
    }
    types = {f.name: f.dataType for f in LISTINGS.fields}

    def inserted_column(name: str) -> Column:
        if name in set_on_insert:
            return set_on_insert[name]
        return F.col(name) if name in parsed.columns else F.lit(None).cast(types[name])

    inserted = joined.select(
        *[F.when(usable, inserted_column(c)).cast(types[c]).alias(c) for c in columns],
        "sighted_number",
        "sightings",
        F.col("first.page_id").alias("first_page"),
        F.col("first.ad_link").alias("first_link"),
        errors.alias("parse_error"),
        F.coalesce(usable & (F.col(KEY) != F.col("sighted_number")), F.lit(False)).alias("number_mismatch"),
        F.when(usable, F.lit("inserted")).otherwise(F.lit("failed")).alias("outcome"),
    )
    return inserted.unionByName(refreshed).select(*columns, *common, "outcome")


def storable(changes: DataFrame) -> DataFrame:
    """Changed records to store, one per ad number even where two sighted numbers share one."""
    rows = changes.where(F.col("outcome") != "failed")
    return latest_per_key(rows, KEY, ("updatedAt", "sighted_number")).select(*LISTINGS.fieldNames())


def page_outcomes(sightings: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows ``(page_id, outcome, n)``: what happened to the ads of every page.

    The page with an ad's first sighting inserts it, its other sightings refresh it; an ad
    that cannot be parsed fails at every sighting.
    """
    per_page = sightings.groupBy("page_id", KEY).agg(F.count(F.lit(1)).alias("n"))
    fate = changes.select(F.col("sighted_number").alias("_key"), "outcome", "first_page")
    rows = per_page.join(fate, per_page[KEY] == fate["_key"], "left")
    is_first = (F.col("outcome") == "inserted") & (F.col("page_id") == F.col("first_page"))
    parts = F.array(
        F.struct(
            F.coalesce(F.when(F.col("outcome") == "failed", F.lit("failed")), F.lit("refreshed")).alias("outcome"),
            (F.col("n") - F.coalesce(is_first.cast("int"), F.lit(0))).alias("n"),
        ),
        F.struct(F.lit("inserted").alias("outcome"), F.coalesce(is_first.cast("bigint"), F.lit(0)).alias("n")),
    )
    return rows.select("page_id", F.inline(parts)).where("n > 0")
