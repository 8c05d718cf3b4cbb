"""Listing tables, lookups, page tables and result files, written and read back."""

import json

from pyspark.sql import functions as F

from lotgrain.operators import lookups as K
from lotgrain.plans import market
from lotgrain.schema import LISTINGS
from lotgrain.sources import listings as SL
from lotgrain.sources import pages as PG


def some_listings(spark, n=60):
    rows = spark.range(n).select(
        F.col("id").alias("ad_number"), F.concat(F.lit("make"), F.col("id") % 4).alias("make"), F.concat(F.lit("model"), F.col("id") % 3).alias("model"),
        (2000 + F.col("id") % 7).cast("int").alias("year"), (F.col("id") * 100).cast("int").alias("price"),
    )
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in LISTINGS if f.name not in rows.columns]
    return rows.select("*", *missing).select(*LISTINGS.names)


def test_listings_are_read_back_and_pruned(spark, tmp_path):
    rows = some_listings(spark)
    SL.write_listings(rows, str(tmp_path / "cars"))
    back = SL.read_listings(spark, str(tmp_path / "cars"))
    assert back.schema == LISTINGS
    assert sorted(back.collect(), key=lambda r: r.ad_number) == rows.orderBy("ad_number").collect()
    some = SL.read_listings(spark, str(tmp_path / "cars"), (F.col("make") == "make1") & (F.col("price") < 3000)).select("ad_number")
    assert sorted(r.ad_number for r in some.collect()) == [i for i in range(30) if i % 4 == 1]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(make,make1)" in plan and "LessThan(price,3000)" in plan
    assert "ReadSchema: struct<ad_number:" in plan and "year" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_results_as_json_lines(spark, tmp_path):
    groups = market.grouped_listings(some_listings(spark), ["make"])
    SL.write_json(groups.select("make", "count"), str(tmp_path / "groups"))
    lines = [json.loads(x) for f in (tmp_path / "groups").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((x["make"], x["count"]) for x in lines) == [(f"make{i}", 15) for i in range(4)]


def test_lookups_from_a_file(spark, tmp_path):
    (tmp_path / "lookups.csv").write_text('domain,key,value\nsafety,ABS,abs\nsafety,"A, B",a_b\noptions,ABS,other\nsafety,,none\n')
    found = SL.read_lookups(spark, str(tmp_path / "lookups.csv"))
    assert {(r.key, r.value) for r in K.domain(found, "safety").collect()} == {("ABS", "abs"), ("A, B", "a_b"), (None, "none")}


def test_pages_are_read_with_their_schema(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert [tuple(r) for r in PG.read_pages(spark, str(tmp_path / "pages")).select("page_id", "url", "html").collect()] == [(1, "u", "<p>")]


def test_lists_of_several_columns_in_one_join(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b", None, "a"], ["x"]), (2, None, []), (3, [], ["y", "?"]), (3, [], ["y", "?"]), (4, None, None)], "n int, one array<string>, two array<string>"
    )
    one = spark.createDataFrame([("a", "A"), ("b", "B"), ("x", "no"), (None, "null")], "key string, value string")
    two = spark.createDataFrame([("x", "X"), ("y", "Y")], "key string, value string")
    want = [(1, ["A", "B", None, "A"], ["X"]), (2, None, []), (3, [], ["Y", None]), (3, [], ["Y", None]), (4, None, None)]
    joined = K.translate_lists(rows, {"one": one, "two": two})
    assert sorted((tuple(r) for r in joined.collect()), key=str) == sorted(want, key=str)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    for most in (0, 100):
        assert sorted((tuple(r) for r in K.translate_checked(rows, {"one": one, "two": two}, most).collect()), key=str) == sorted(want, key=str)
