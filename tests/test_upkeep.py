import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotgrain.operators import lifetimes as LT
from lotgrain.operators import upkeep as S

DAY0 = datetime(2024, 1, 1)


def day(n, **more):
    return DAY0 + timedelta(days=n, **more)


def sightings(spark, *rows):
    """Rows (ad, day, seq)."""
    data = [(ad, f"/{ad}/{seq}", f"i{seq}", 1, seq, day(d)) for ad, d, seq in rows]
    schema = "ad_number long, ad_link string, img_link string, page_id long, seq long, seen_at timestamp"
    return spark.createDataFrame(data, schema)


def stored(spark, *rows):
    """Rows (ad, price, day of last update)."""
    data = [(ad, f"/{ad}", None, price, day(0), None if d is None else day(d)) for ad, price, d in rows]
    schema = "ad_number long, link string, ad_link string, price int, createdAt timestamp, updatedAt timestamp"
    return spark.createDataFrame(data, schema)


def test_upsert_replaces_whole_records_and_inserts(spark):
    new = stored(spark, (1, 5, 2), (1, 6, 3), (9, 7, 1))
    rows = S.upsert(stored(spark, (1, 1, 0), (2, 2, 0)), new).orderBy("ad_number").collect()
    assert [(r.ad_number, r.price) for r in rows] == [(1, 6), (2, 2), (9, 7)]
    assert S.duplicate_keys(new).collect() == [(1, 2)]


def test_refresh_touches_two_columns_and_inserts_nothing(spark):
    old = stored(spark, (1, 10, 1), (2, 20, 1), (3, 30, 5))
    seen = sightings(spark, (1, 2, 1), (1, 2, 2), (7, 2, 3), (3, 4, 4))
    rows = {r.ad_number: r for r in S.refresh(old, seen).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert (rows[1].ad_link, rows[1].updatedAt, rows[1].price, rows[1].link) == ("/1/2", day(2), 10, "/1")
    assert rows[1].createdAt == day(0)
    assert rows[2].ad_link is None and rows[2].updatedAt == day(1)
    # A late sighting does not move the update time back.
    assert rows[3].updatedAt == day(5) and rows[3].ad_link is None


def test_retention_boundary_and_missing_dates(spark):
    rows = S.retain(stored(spark, (1, 1, 3), (2, 1, None), (3, 1, 2)), day(10)).collect()
    assert sorted(r.ad_number for r in rows) == [1, 2]


def test_new_and_known_split_the_sighted_ads(spark):
    seen = sightings(spark, (1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 1, 4), (3, 3, 5))
    base = stored(spark, (1, 1, 0), (4, 1, 0))
    new = {r.ad_number: r.seq for r in S.new_ads(seen, base).collect()}
    known = {r.ad_number: r.seq for r in S.known_ads(seen, base).collect()}
    assert new == {2: 3, 3: 4} and known == {1: 2}


def test_merge_takes_the_ad_pages_number(spark):
    short = spark.createDataFrame([(1, "/1", "i"), (2, "/2", None)], "ad_number long, ad_link string, img_link string")
    details = spark.createDataFrame([(1, 1, 5), (2, 8, 6)], "sighted_number long, ad_number long, price int")
    rows = S.merge_short_and_details(short, details).orderBy("ad_number").collect()
    assert [tuple(r) for r in rows] == [("/1", "i", 1, 5, False), ("/2", None, 8, 6, True)]


@pytest.mark.parametrize(
    "days, lives",
    [([0, 7, 13], [(0, 13, 20)]), ([0, 8], [(0, 0, 7), (8, 8, 15)]), ([0, 7], [(0, 7, 14)]), ([3, 3], [(3, 3, 10)])],
)
def test_lifetimes(spark, days, lives):
    seen = sightings(spark, *[(1, d, i) for i, d in enumerate(days)])
    rows = LT.lifetimes(seen).orderBy("createdAt").collect()
    assert [(r.createdAt, r.updatedAt, r.expiresAt) for r in rows] == [tuple(day(x) for x in life) for life in lives]


def test_lifetimes_equal_session_windows(spark):
    hours = F.col("id") * F.col("id") * 37 % 9001
    seen = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("ad_number"),
        (F.lit(DAY0) + F.make_dt_interval(hours=hours.cast("int"))).alias("seen_at"),
    )
    ours = LT.lifetimes(seen, gap_seconds=24 * 3600)
    windows = seen.groupBy("ad_number", F.session_window("seen_at", "24 hours").alias("w")).agg(
        F.max("seen_at").alias("updatedAt"), F.count(F.lit(1)).alias("sightings")
    )
    theirs = windows.select("ad_number", F.col("w.start").alias("createdAt"), "updatedAt", F.col("w.end").alias("expiresAt"), "sightings")
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_overlapping_intervals_join(spark):
    rows = [(1, 0, 100), (1, 10, 20), (1, 105, 106), (1, 120, 121)]
    df = spark.createDataFrame(rows, "k int, s long, e long")
    found = LT.number_islands(df, "k", "s", "e", 10).orderBy("s").collect()
    assert [r.life for r in found] == [1, 1, 1, 2]


def test_rows_without_time_or_number_come_first_and_repeats_count_once(spark):
    rows = sightings(spark, (1, 0, 5), (1, 0, 5), (2, 1, 1), (None, 0, 2), (None, 1, 1))
    bare = rows.where("ad_number = 2").withColumn("seen_at", F.lit(None).cast("timestamp")).withColumn("seq", F.lit(9).cast("long"))
    rows = rows.unionByName(bare).unionByName(bare.withColumn("ad_number", F.lit(7).cast("long")))
    rows = rows.unionByName(rows.where("seq = 5").withColumn("seq", F.lit(None).cast("long")))
    last = {r.ad_number: r.seq for r in S.latest_per_key(rows, order=("seen_at", "seq")).collect()}
    first = {r.ad_number: r.seq for r in S.first_sightings(rows).collect()}
    assert last == {1: 5, 2: 1, 7: 9, None: 1} and first == {1: None, 2: 9, 7: 9, None: 2}
    assert S.latest_per_key(rows.limit(0), order=("seen_at", "seq")).count() == 0
    with pytest.raises(ValueError):
        S.latest_per_key(rows, order=("seen_at", "seq", "page_id"))


@pytest.mark.parametrize("form", ["upsert", "refresh", "new_ads", "known_ads"])
def test_rows_are_chosen_in_hash_maps_on_the_map_side(spark, tmp_path, form):
    sightings(spark, *[(i % 3, i, i) for i in range(1, 20)]).write.parquet(f"{tmp_path}/seen")
    stored(spark, (1, 1, 0), (5, 2, 0)).write.parquet(f"{tmp_path}/stored")
    seen, base = spark.read.parquet(f"{tmp_path}/seen"), spark.read.parquet(f"{tmp_path}/stored")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if form == "upsert":
            rows = S.upsert(base, seen.selectExpr("ad_number", "ad_link link", "ad_link", "1 price", "seen_at createdAt", "seen_at updatedAt", "seq"), order=("updatedAt", "seq"))
        else:
            rows = S.refresh(base, seen) if form == "refresh" else getattr(S, form)(seen, base)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # From each scan upwards to the first exchange: filters, projections and hash maps.
    lines = plan.splitlines()
    for at in [i for i, line in enumerate(lines) if "FileScan" in line]:
        depth, below = re.search(r"[A-Z]", lines[at]).start(), []
        for line in reversed(lines[:at]):
            here = re.search(r"[A-Z]", line).start()
            if here < depth:
                if "Exchange" in line:
                    break
                depth = here
                below.append(line)
        assert not [line for line in below if "Sort" in line], plan
    assert plan.count("HashAggregate") >= 2
