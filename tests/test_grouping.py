import pytest
from pyspark.sql import functions as F

from lotgrain.operators import grouping as G
from lotgrain.operators import labels as L
from lotgrain.operators import lookups as K
from lotgrain.plans import market

SCHEMA = (
    "ad_number bigint, link string, img_src string, make string, model string, year int, price int,"
    "engine_power int, engine_capacity int"
)
ROWS = [
    (1, "/1", "1.jpg", "Bmw", "X1", 2016, 8000, 100, 1998),
    (2, "/2", None, "Bmw", "X1", 2015, 9000, 100, 1998),
    (3, "/3", "3.jpg", "Bmw", "X1", 2016, 8500, 100, 1998),
    (4, None, None, "Bmw", "X5", 2018, 20000, 200, 2993),
    (5, "/5", "5.jpg", "Audi", "A4", 2014, 7000, None, 1968),
]


@pytest.fixture(scope="module")
def cars(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_groups_in_order(cars):
    rows = market.grouped_listings(cars, ["make", "model"]).collect()
    assert [(r.make, r.model, r["count"], r.valid_count) for r in rows] == [
        ("Bmw", "X1", 3, 3), ("Audi", "A4", 1, 0), ("Bmw", "X5", 1, 1),
    ]
    assert [r.label for r in rows] == [
        "Bmw X1 2015-2016 (3) - EUR 8000 - EUR 9000", "Audi A4 2014 (1) - EUR 7000", "Bmw X5 2018 (1) - EUR 20000",
    ]


def test_threshold_and_keys(cars):
    assert [r.model for r in G.group_counts(cars, ["make", "model"], 2).collect()] == ["X1"]
    by_make = {r.make: r["count"] for r in G.group_counts(cars, ["make"]).collect()}
    assert by_make == {"Bmw": 4, "Audi": 1}
    assert [r["count"] for r in G.group_counts(cars, []).collect()] == [5]
    assert G.group_counts(cars.where("false"), []).collect() == []
    with pytest.raises(ValueError, match="colour"):
        G.group_counts(cars, ["make", "colour"])


def test_counts_fall_with_the_threshold_and_sum_to_the_rows(cars):
    totals = [sum(r["count"] for r in G.group_counts(cars, ["make", "year"], n).collect()) for n in range(1, 6)]
    assert totals[0] == len(ROWS) and totals == sorted(totals, reverse=True)


def test_members(cars):
    groups = {(r.make, r.model): r for r in G.group_members(cars, ["make", "model"]).collect()}
    assert [c.year for c in groups["Bmw", "X1"].cars] == [2015, 2016, 2016]
    assert groups["Audi", "A4"].cars == [None] and groups["Audi", "A4"]["count"] == 1
    assert groups["Bmw", "X5"].cars[0].asDict() == {
        "id": "4", "link": None, "img_src": None, "make": "Bmw", "model": "X5", "year": 2018, "price": 20000,
        "engine_power": 200, "engine_capacity": 2993,
    }
    by_price = {(r.make, r.model): r for r in G.group_members(cars, ["make", "model"], sort_by="price").collect()}
    assert [c.price for c in by_price["Bmw", "X1"].cars] == [8000, 8500, 9000]
    (everything,) = G.group_members(cars, []).collect()
    assert everything["count"] == 5 and len(everything.cars) == 5
    assert G.group_members(cars, [], min_count=6).collect() == []


def test_null_keys_form_a_group_in_every_form(spark, cars):
    extra = spark.createDataFrame([(6, "/6", None, None, None, None, None, None, None)] * 2, SCHEMA)
    both = cars.unionByName(extra)
    for form in (G.group_counts, G.group_summary, G.group_members):
        assert [r["count"] for r in form(both, ["make", "model"]).where("make is null").collect()] == [2]
    assert G.group_rows(both, ["make", "model"]).where("make is null").count() == 2


def test_large_groups_come_whole_in_ordered_chunks(spark):
    # One make has a third of the rows, and one year most of that make.
    n = 3000
    i = F.col("id")
    rows = spark.range(n).select(
        i.alias("ad_number"), F.lit("/x").alias("link"), F.lit(None).cast("string").alias("img_src"),
        F.when(i < n / 3, "Hot").otherwise(F.concat(F.lit("M"), i % 50)).alias("make"), F.lit("m").alias("model"),
        F.when(i < n / 4, F.lit(2010)).when(i % 40 == 0, F.lit(None)).otherwise(2000 + i % 20).cast("int").alias("year"),
        (i % 700).cast("int").alias("price"), F.lit(1).alias("engine_power"), F.lit(1).alias("engine_capacity"),
    )
    chunks = G.group_members(rows, ["make"], chunk_rows=50).collect()
    members = [c for r in chunks for c in r.cars]
    assert len(members) == n
    found = sorted(int(c.id) for c in members if c is not None)
    assert len(found) == len(set(found)) == rows.where("year is not null").count()
    hot = sorted([r for r in chunks if r.make == "Hot"], key=lambda r: r.chunk)
    assert len(hot) > 10 and {r["count"] for r in hot} == {1000}
    years = [c.year for r in hot for c in r.cars if c is not None]
    assert years == sorted(years)
    assert max(len(r.cars) for r in chunks) < 4 * 50
    assert all(r.chunk == 0 for r in chunks if r["count"] <= 50)


@pytest.mark.parametrize("keys", [["make"], []])
def test_null_ids_of_one_price_do_not_meet_in_one_array(spark, keys):
    n = 50_000
    rows = spark.range(n).select(
        F.lit(None).cast("long").alias("ad_number"), F.concat(F.lit("/"), "id").alias("link"), F.lit(None).cast("string").alias("img_src"),
        F.lit("Hot").alias("make"), F.lit("m").alias("model"), F.lit(2010).alias("year"), F.lit(500).alias("price"),
        F.lit(1).alias("engine_power"), F.lit(1).alias("engine_capacity"),
    )
    chunks = G.group_members(rows, keys, sort_by="price", chunk_rows=1000).select("count", F.size("cars").alias("size")).collect()
    assert sum(r.size for r in chunks) == n and {r["count"] for r in chunks} == {n}
    assert len(chunks) == 50 and max(r.size for r in chunks) < 2000


def test_groups_below_the_threshold_are_not_gathered(cars):
    rows = G.group_members(cars, ["make"], 2).collect()
    assert [(r.make, r["count"], r.valid_count, len(r.cars)) for r in rows] == [("Bmw", 4, 4, 4)]


def test_members_come_from_two_scans(spark, cars, tmp_path):
    cars.write.parquet(f"{tmp_path}/cars")
    plan = G.group_members(spark.read.parquet(f"{tmp_path}/cars"), ["make"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_flat_members(cars):
    rows = G.group_rows(cars, ["make"], 2).collect()
    assert sorted(r.id for r in rows) == ["1", "2", "3", "4"] and {r["count"] for r in rows} == {4}
    assert {r["count"] for r in G.group_rows(cars, []).collect()} == {5}


def test_makes_and_models(spark, cars):
    rows = {r.make: r.models for r in market.make_dictionary(cars).collect()}
    assert rows == {"Audi": ["A4"], "Bmw": ["X1", "X5"]}
    many = spark.range(95).select(F.lit("A").alias("make"), F.concat(F.lit("m"), "id").alias("model"))
    parts = G.makes_models(many.unionByName(many), chunk_rows=20).collect()
    assert len(parts) > 1 and sorted(m for r in parts for m in r.models) == sorted(f"m{i}" for i in range(95))
    empty = spark.createDataFrame([(None, "m"), ("B", None)], "make string, model string")
    assert {r.make: r.models for r in market.make_dictionary(empty).collect()} == {None: ["m"], "B": []}


def test_image_is_the_first_members(cars):
    rows = {(r.make, r.model): r.img_src for r in G.group_image(cars, ["make", "model"]).collect()}
    assert rows == {("Bmw", "X1"): "1.jpg", ("Bmw", "X5"): None, ("Audi", "A4"): "5.jpg"}


def test_listing_label(cars):
    row = cars.where("ad_number = 1").select(L.listing_label().alias("l"), L.listing_url("https://h").alias("u")).first()
    assert (row.l, row.u) == ("Bmw X1 - 2016 (1998cm3) - EUR 8000", "https://h/1")


def test_search_groups(spark, cars):
    groups = market.search_groups(cars, ["make"], "?price_to=8500", exclude={"audi": None}).collect()
    assert [(r.make, r["count"]) for r in groups] == [("Bmw", 2)]


def test_no_shuffle_beyond_the_keys(cars):
    plan = G.group_summary(cars, ["make", "model"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


@pytest.mark.parametrize("by_join", [False, True])
def test_translate_list(spark, by_join):
    dim = spark.createDataFrame([("ABS", "abs"), ("Anti-lock", "abs"), ("ESP", "esp")], "key string, value string")
    df = spark.createDataFrame([(1, ["ABS", "?", "Anti-lock"]), (2, []), (3, None), (None, ["ESP"]), (None, ["ABS"])], "id int, safety array<string>")
    rows = K.translate_list(df, "safety", dim, by_join).collect()
    assert sorted((str(r.id), r.safety) for r in rows) == [
        ("1", ["abs", None, "abs"]), ("2", []), ("3", None), ("None", ["abs"]), ("None", ["esp"]),
    ]
    assert K.translate_list(df, "safety", dim.limit(0), by_join).where("id = 1").first().safety == [None, None, None]
