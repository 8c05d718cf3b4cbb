"""Every operator on the shared test tables, each next to the SQL that must give the same rows.

The tables stand in for listings: ``part`` for stored listings (brand, type, size and retail
price as make, model, year and price), ``events`` for sightings of ads (users), ``orders`` and
``customer`` for pages rendered from their columns, ``pages`` for raw markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.functions import markup as M
from lotgrain.functions import text as X
from lotgrain.functions import urls as U
from lotgrain.operators import grouping as G
from lotgrain.operators import labels as L
from lotgrain.operators import lifetimes as LT
from lotgrain.operators import lookups as K
from lotgrain.operators import predicates as P
from lotgrain.operators import upkeep as S
from lotgrain.operators.facets import facet_filter
from lotgrain.plans import extraction as E
from lotgrain.plans import ingest as I
from lotgrain.plans import market
from lotgrain.session import shared_folder
from lotgrain.sources import pages as PG
from lotgrain.sources.listings import group_json
from lotgrain.sources.snapshots import ListingSnapshots
from lotgrain.streaming.ingest import BatchIngest, PageRun, await_run, details_from, start_ingest
from lotgrain.streaming.watermarked import ended_lives, first_seen


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        # Zone-less event times become instants; both sides of a comparison read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def joined(values: str | Column, by: str = ",") -> Column:
    return F.array_join(values, by)


def same(name: Column) -> Column:
    """Names in these tables are upper case already and are compared as they are."""
    return name


# ------------------------------------------------------------------- predicates


@query(
    "filter_range",
    "select p_partkey, p_size, p_retailprice from part where p_size between 5 and 20 and p_retailprice >= 950",
)
def _(t: Tables) -> DataFrame:
    wanted = P.all_active([P.in_range("p_size", "5", 20), P.in_range("p_retailprice", 950)])
    return t.part.where(wanted).select("p_partkey", "p_size", "p_retailprice")


@query(
    "filter_range_skipped",
    "select p_partkey from part",
)
def _(t: Tables) -> DataFrame:
    # A bound that is no whole number switches the range off, its good bound included.
    wanted = [P.in_range("p_size", "8000.5", "3"), P.in_range("p_size", "abc"), P.in_range("p_size")]
    return t.part.where(P.all_active(wanted)).select("p_partkey")


@query(
    "filter_equals",
    "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'",
)
def _(t: Tables) -> DataFrame:
    return t.orders.where(P.equals("o_orderstatus", "F")).select("o_orderkey", "o_orderstatus")


@query(
    "filter_one_of",
    "select p_partkey, p_brand from part where p_brand in ('Brand#2', 'Brand#17')",
)
def _(t: Tables) -> DataFrame:
    return t.part.where(P.one_of("p_brand", ["Brand#2", "Brand#17"])).select("p_partkey", "p_brand")


@query(
    "filter_one_of_nullable",
    """
    select p_partkey, nullif(p_type, 'ECONOMY') as model from part
    where nullif(p_type, 'ECONOMY') = 'LARGE' or nullif(p_type, 'ECONOMY') is null
    """,
)
def _(t: Tables) -> DataFrame:
    typed = t.part.select("p_partkey", F.nullif("p_type", F.lit("ECONOMY")).alias("model"))
    return typed.where(P.one_of("model", ["LARGE", None]))


@query(
    "filter_all_of",
    """
    with sets as (
      select user_id, cast(ts as date) as day, list(distinct event_type) as kinds
      from events group by all)
    select user_id, cast(day as varchar) as day, array_to_string(list_sort(kinds), ',') as kinds
    from sets where list_has_all(kinds, ['click', 'purchase'])
    """,
)
def _(t: Tables) -> DataFrame:
    kinds = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    sets = kinds.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("event_type")).alias("kinds"))
    hits = sets.where(P.all_of("kinds", ["click", "purchase"]))
    return hits.select("user_id", F.col("day").cast("string").alias("day"), joined("kinds").alias("kinds"))


PART_LISTINGS = """
    listings as (
      select p_partkey as ad_number,
             '/auto-oglasi/' || p_partkey || '/' || replace(p_name, ' ', '-') as link,
             'img/' || p_partkey || '.jpg' as img_src,
             p_brand as make, nullif(p_type, 'ECONOMY') as model, p_size as year,
             cast(floor(p_retailprice) as int) as price,
             nullif(p_size, 7) as engine_power, p_size * 40 as engine_capacity
      from part),
    checked as (
      select *, make is not null and model is not null and engine_power is not null as valid
      from listings)
"""


def part_listings(t: Tables) -> DataFrame:
    """``part`` as listings; one type becomes a missing model, one size a missing power."""
    key = F.col("p_partkey")
    return t.part.select(
        key.alias("ad_number"),
        F.concat(F.lit("/auto-oglasi/"), key, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("link"),
        F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("img_src"),
        F.col("p_brand").alias("make"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("model"),
        F.col("p_size").alias("year"),
        F.floor("p_retailprice").cast("int").alias("price"),
        F.nullif("p_size", F.lit(7)).alias("engine_power"),
        (F.col("p_size") * 40).alias("engine_capacity"),
    )


@query(
    "include_make_model",
    """
    select p_partkey, p_brand, p_type from part
    where (p_brand = 'Brand#2' and p_type in ('LARGE', 'PROMO')) or p_brand = 'Brand#9'
    """,
)
def _(t: Tables) -> DataFrame:
    makes = {"Brand#2": ["LARGE", "PROMO"], "Brand#9": None, "": ["SMALL"]}
    wanted = P.include_makes(makes, make="p_brand", model="p_type", normalize=same)
    return t.part.where(wanted).select("p_partkey", "p_brand", "p_type")


@query(
    "exclude_make_model",
    """
    with l as (select p_partkey, nullif(p_brand, 'Brand#3') as make, nullif(p_type, 'ECONOMY') as model from part)
    select * from l
    where make is distinct from 'Brand#2' and (model is null or model not in ('LARGE', 'PROMO'))
      and make is distinct from 'Brand#9'
    """,
)
def _(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#3")).alias("make"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("model"),
    )
    return rows.where(P.exclude_makes({"Brand#2": ["LARGE", "PROMO"], "Brand#9": []}, normalize=same))


@query(
    "normalized_make_filter",
    """
    with l as (
      select c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as make,
             'Customer ' || c_nationkey as model from customer)
    select * from l where (make = 'Building' and model in ('Customer 3', 'Customer 4')) or make = 'Machinery'
    """,
)
def _(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        X.normalize_name(F.col("c_mktsegment")).alias("make"),
        X.normalize_name(F.concat(F.lit("customer-"), "c_nationkey")).alias("model"),
    )
    return rows.where(P.include_makes({"BUILDING": ["customer-3", "CUSTOMER 4"], "machinery": None}))


@query(
    "compact_array",
    """
    select event_id, array_to_string(list_filter([nullif(event_type, 'click'), nullif(event_type, 'view')],
           lambda x: x is not null), ',') as kept
    from events
    """,
)
def _(t: Tables) -> DataFrame:
    pair = F.array(F.nullif("event_type", F.lit("click")), F.nullif("event_type", F.lit("view")))
    return t.events.select("event_id", joined(X.compact_strings(pair)).alias("kept"))


CUSTOMER_LISTINGS = """
    listings as (
      select c_custkey as ad_number,
             upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as make, c_name as model,
             cast(floor(c_acctbal) as int) as price, c_nationkey + 2000 as year,
             nullif(n_name, 'NATION_5') as fuel_type
      from customer left join nation on c_nationkey = n_nationkey)
"""


def nation_lookup(t: Tables, domain: str) -> DataFrame:
    return t.nation.select(
        F.lit(domain).alias("domain"),
        F.col("n_nationkey").cast("string").alias("key"),
        F.col("n_name").alias("value"),
    )


def customer_listings(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("_code", F.col("c_nationkey").cast("string"))
    rows = K.translate(rows, "_code", K.domain(nation_lookup(t, "fuel_type"), "fuel_type"), "_label")
    kind = F.nullif("_label", F.lit("NATION_5"))
    return rows.select(
        F.col("c_custkey").alias("ad_number"),
        X.normalize_name(F.col("c_mktsegment")).alias("make"),
        F.col("c_name").alias("model"),
        F.floor("c_acctbal").cast("int").alias("price"),
        (F.col("c_nationkey") + 2000).alias("year"),
        kind.alias("fuel_type"),
        F.array("c_mktsegment", kind).alias("safety"),
    )


@query(
    "facet_conjunction",
    f"""
    with {CUSTOMER_LISTINGS}
    select ad_number, make, price, year, fuel_type from listings
    where price >= 0 and price <= 7000 and year >= 2002
      and (fuel_type in ('NATION_3', 'NATION_7') or fuel_type is null)
      and make in ('Building', 'Machinery', 'Household') and make is distinct from 'Machinery'
    """,
)
def _(t: Tables) -> DataFrame:
    url = (
        "https://ads.example/search?brand=BUILDING&brand2=household&price_from=0&price_to=7000"
        "&yearFrom=2002&mileage_from=x&fuel%5B%5D=3&fuel%5B%5D=7&fuel%5B%5D=9999&city="
    )
    wanted = facet_filter(
        url,
        nation_lookup(t, "fuel_type"),
        include='{"machinery": null}',
        exclude='{"machinery": []}',
    )
    return customer_listings(t).where(wanted).select("ad_number", "make", "price", "year", "fuel_type")


@query(
    "facet_features",
    f"""
    with {CUSTOMER_LISTINGS}
    select ad_number, make from listings where make = 'Building' and fuel_type = 'NATION_3'
    """,
)
def _(t: Tables) -> DataFrame:
    # Feature names count by presence; here segments and nations play the feature codes.
    names = nation_lookup(t, "safety").unionByName(
        t.customer.select(
            F.lit("safety").alias("domain"), F.col("c_mktsegment").alias("key"), F.col("c_mktsegment").alias("value")
        ).distinct()
    )
    lookups = names.withColumn("value", F.concat(F.lit("has_"), F.lower("value")))
    rows = customer_listings(t)
    coded = F.transform("safety", lambda s: F.concat(F.lit("has_"), F.lower(s)))
    wanted = facet_filter("?has_building=0&has_nation_3=1&other=1&has_nation_4=", lookups)
    return rows.withColumn("safety", coded).where(wanted).select("ad_number", "make")


_ONE_OF = ("body_type", "fuel_type", "transmission", "climate_control", "damage", "interior_material")
_CODE_PARAMS = ("chassis", "fuel", "gearbox", "air_condition", "damaged", "interior_material")


@query(
    "facet_all",
    f"""
    select p_partkey as ad_number from part
    where floor(p_retailprice) <= 1800 and p_size >= 2 and p_size + 40 between 43 and 90 and p_size * 40 <= 1950
      and p_partkey * 10 >= 50
      and {" and ".join(f"(p_partkey + {i}) % 10 <> 9" for i in range(len(_ONE_OF)))}
      and p_partkey % 5 <> 0 and p_partkey % 6 <> 0
      and p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_partkey % 13 <> 0
      and p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') and p_brand is distinct from 'Brand#2'
    """,
)
def _(t: Tables) -> DataFrame:
    # Every facet is active at once; codes are the nations' keys, labels 'L' and the code.
    key = F.col("p_partkey")

    def label(i: int, codes: int) -> Column:
        return F.concat(F.lit("L"), ((key + i) % codes).cast("string"))

    rows = t.part.select(
        key.alias("ad_number"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"),
        F.floor("p_retailprice").cast("int").alias("price"), F.col("p_size").alias("year"),
        (F.col("p_size") + 40).alias("engine_power"), (F.col("p_size") * 40).alias("engine_capacity"),
        (key * 10).alias("mileage"),
        *[label(i, 10).alias(c) for i, c in enumerate(_ONE_OF)],
        F.when(key % 5 != 0, F.lit("L1")).otherwise(F.lit("L0")).alias("steering_side"),
        F.when(key % 6 != 0, F.lit("L2")).otherwise(F.lit("L0")).alias("emission_class"),
        F.array(F.lit("abs"), F.when(key % 7 != 0, F.lit("esp"))).alias("safety"),
        F.array(F.when(key % 11 != 0, F.lit("car_play"))).alias("options"),
        F.array(F.lit("x"), F.when(key % 13 != 0, F.lit("garage"))).alias("details"),
    )
    code = F.col("n_nationkey").cast("string")
    domains = F.explode(F.array(*[F.lit(c) for c in (*_ONE_OF, "steering_side", "emission_class")]))
    lookups = t.nation.select(domains.alias("domain"), code.alias("key"), F.concat(F.lit("L"), code).alias("value"))
    features = [("safety", "ABS", "abs"), ("safety", "ESP", "esp"), ("options", "CarPlay", "car_play"), ("details", "Garage", "garage")]
    lookups = lookups.unionByName(t.spark.createDataFrame(features, lookups.schema))
    codes = "&".join(f"{p}[]={i}" for p in _CODE_PARAMS for i in range(9))
    address = (
        "https://ads.example/s?price_to=1800&year_from=2&power_from=43&power_to=90&engine_volume_to=1950&mileage_from=50"
        f"&{codes}&wheel_side=1&emission_class=2&abs=1&esp=1&carPlay=1&garage=0&brand=Brand%231&brand2=Brand%233"
    )
    wanted = facet_filter(address, lookups, '{"Brand#2": null, "Brand#4": null}', '{"Brand#2": null}', same)
    return rows.where(wanted).select("ad_number")


# --------------------------------------------------------------------- grouping


def _group_sql(keys: str, min_count: int) -> str:
    listed = f"{keys}, " if keys else ""
    by = f"group by {keys}" if keys else ""
    return f"""
    with {PART_LISTINGS}
    select {listed}count(*) as count, count(*) filter (where valid) as valid_count
    from checked {by} having count(*) >= {min_count}
    """


@query("group_by_1", _group_sql("make", 1))
def _(t: Tables) -> DataFrame:
    return G.group_counts(part_listings(t), ["make", "make"])


@query("group_by_2", _group_sql("make, model", 12))
def _(t: Tables) -> DataFrame:
    return G.group_counts(part_listings(t), ["make", "model"], 12)


@query("group_by_3", _group_sql("make, model, year", 2))
def _(t: Tables) -> DataFrame:
    return G.group_counts(part_listings(t), ["make", "model", "year"], 2)


@query("group_all", _group_sql("", 1))
def _(t: Tables) -> DataFrame:
    return G.group_counts(part_listings(t), [])


def _label_sql(make: bool, model: bool) -> str:
    return (
        ("coalesce(make || ' ', '') || " if make else "")
        + ("coalesce(model || ' ', '') || " if model else "")
        + """case when count = 1 or min_year = max_year then cast(min_year as varchar)
             else min_year || '-' || max_year end
        || ' (' || count || ') - '
        || case when min_price = max_price then 'EUR ' || min_price
             else 'EUR ' || min_price || ' - EUR ' || max_price end"""
    )


def _summary_sql(keys: str, where: str, min_count: int, label: str) -> str:
    return f"""
    with {PART_LISTINGS},
    grouped as (
      select {keys}, count(*) as count, count(*) filter (where valid) as valid_count,
             min(year) as min_year, max(year) as max_year, min(price) as min_price, max(price) as max_price
      from checked where {where} group by {keys} having count(*) >= {min_count})
    select *, {label} as label from grouped
    """


@query(
    "group_summary",
    _summary_sql("make, model", "year between 5 and 40 and make is distinct from 'Brand#2'", 3, _label_sql(True, True)),
)
def group_summary(t: Tables) -> DataFrame:
    wanted = P.all_active([P.in_range("year", 5, 40), P.exclude_makes({"brand#2": None})])
    return market.grouped_listings(part_listings(t), ["make", "model"], wanted, 3)


@query("group_label_by_year", _summary_sql("year", "true", 1, _label_sql(False, False)))
def _(t: Tables) -> DataFrame:
    return market.grouped_listings(part_listings(t), ["year"])


@query("group_label_by_model", _summary_sql("model", "true", 1, _label_sql(False, True)))
def _(t: Tables) -> DataFrame:
    return market.grouped_listings(part_listings(t), ["model"])


@query(
    "group_image",
    f"""
    with {PART_LISTINGS}
    select make, model, arg_min(img_src, ad_number) as img_src from listings group by make, model
    """,
)
def _(t: Tables) -> DataFrame:
    return G.group_image(part_listings(t), ["make", "model"])


def _flat_cars(cars: str = "cars") -> Column:
    return joined(
        F.transform(
            cars,
            lambda c: F.when(c.isNull(), F.lit("-")).otherwise(
                F.concat_ws(":", c["year"].cast("string"), c["price"].cast("string"), c["id"])
            ),
        )
    )


# A chunk is full at this many rows in the queries below; production uses far more.
CHUNK = 20


def _members_sql(keys: str, min_count: int, order: str) -> str:
    """Members by chunk; an order value alone stays below two chunks here, so none is split."""
    listed = f"{keys}, " if keys else ""
    on = " and ".join(f"c.{k} is not distinct from g.{k}" for k in keys.split(", ")) if keys else "true"
    part = f"partition by {keys}" if keys else ""
    return f"""
    with {PART_LISTINGS},
    sizes as (select {listed}{order}, count(*) as n from checked group by all),
    starts as (select *, coalesce(sum(n) over ({part} order by {order} nulls first rows between unbounded preceding and 1 preceding), 0) as s
               from sizes),
    groups as (select {listed}count(*) as count, count(*) filter (where valid) as valid_count
               from checked {f"group by {keys}" if keys else ""} having count(*) >= {min_count}),
    placed as (select c.*, cast(floor(g.s / {CHUNK}) as bigint) as chunk
               from checked c join starts g on {on} and c.{order} is not distinct from g.{order})
    select {"".join(f"c.{k}, " for k in keys.split(", ")) if keys else ""}g.count, g.valid_count, chunk,
           string_agg(case when valid then year || ':' || price || ':' || ad_number else '-' end, ','
                      order by {order}, cast(ad_number as varchar)) as cars
    from placed c join groups g on {on} group by all
    """


@query("group_members", _members_sql("make, model", 2, "year"))
def _(t: Tables) -> DataFrame:
    groups = G.group_members(part_listings(t), ["make", "model"], 2, chunk_rows=CHUNK)
    return groups.select("make", "model", "count", "valid_count", "chunk", _flat_cars().alias("cars"))


@query("group_members_by_price", _members_sql("make", 1, "price"))
def _(t: Tables) -> DataFrame:
    groups = G.group_members(part_listings(t), ["make"], 1, "price", chunk_rows=CHUNK)
    return groups.select("make", "count", "valid_count", "chunk", _flat_cars().alias("cars"))


@query(
    "group_member_chunks",
    f"""
    with {PART_LISTINGS}
    select make, count(*) as count, cast(count(*) as bigint) as members,
           cast(0 as bigint) as misplaced, true as all_small
    from checked group by make
    """,
)
def _(t: Tables) -> DataFrame:
    # Large groups come in chunks: all members are there, in order, and no array is long.
    chunks = G.group_members(part_listings(t), ["make"], chunk_rows=20)
    sizes = chunks.select(
        "make", "count", "chunk", F.size("cars").alias("n"),
        F.array_min(F.transform("cars", lambda c: c["year"])).alias("low"),
        F.array_max(F.transform("cars", lambda c: c["year"])).alias("high"),
    )
    before = F.lag("high").over(G.Window.partitionBy("make").orderBy("chunk"))
    return (
        sizes.withColumn("late", F.coalesce(before > F.col("low"), F.lit(False)))
        .groupBy("make", "count")
        .agg(
            F.sum("n").alias("members"),
            F.count_if("late").alias("misplaced"),
            (F.max("n") <= 20 * 5).alias("all_small"),
        )
    )


@query("group_all_members", _members_sql("", 1, "price"))
def _(t: Tables) -> DataFrame:
    groups = G.group_members(part_listings(t), [], sort_by="price", chunk_rows=CHUNK)
    return groups.select("count", "valid_count", "chunk", _flat_cars().alias("cars"))


@query(
    "group_rows",
    f"""
    with {PART_LISTINGS},
    counted as (select make, model, count(*) as count, count(*) filter (where valid) as valid_count
                from checked group by make, model having count(*) >= 12)
    select cast(ad_number as varchar) as id, link, img_src, c.make, c.model, year, price, engine_power,
           engine_capacity, valid, count, valid_count
    from checked c join counted g on c.make is not distinct from g.make and c.model is not distinct from g.model
    """,
)
def _(t: Tables) -> DataFrame:
    return G.group_rows(part_listings(t), ["make", "model"], 12)


@query(
    "makes_models",
    f"""
    with {PART_LISTINGS}
    select make, 0::bigint as chunk, array_to_string(list_sort(list(distinct model) filter (where model is not null)), ',') as models
    from listings group by make
    """,
)
def _(t: Tables) -> DataFrame:
    return market.make_dictionary(part_listings(t)).select("make", F.col("chunk").cast("bigint").alias("chunk"), joined("models").alias("models"))


@query(
    "listing_label",
    f"""
    with {PART_LISTINGS}
    select ad_number,
           make || ' ' || model || ' - ' || year || ' (' || engine_capacity || 'cm3) - EUR ' || price as label,
           'https://ads.example' || link as url
    from listings
    """,
)
def _(t: Tables) -> DataFrame:
    return part_listings(t).select(
        "ad_number", L.listing_label().alias("label"), L.listing_url("https://ads.example").alias("url")
    )


def _json_sql(fields: dict[str, str]) -> str:
    """A JSON object in field order, null fields left out."""
    parts = ", ".join(f"""'"{name}":' || {value}""" for name, value in fields.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def _quoted(name: str) -> str:
    return f"""'"' || {name} || '"'"""


_CAR_JSON = _json_sql(
    {
        "id": _quoted("ad_number"), "link": _quoted("link"), "img_src": _quoted("img_src"), "make": _quoted("make"),
        "model": _quoted("model"), "year": "year", "price": "price", "engine_power": "engine_power",
        "engine_capacity": "engine_capacity",
    }
)


@query(
    "group_json",
    f"""
    with summed as ({_summary_sql("make", "true", 1, _label_sql(True, False))})
    select {_json_sql({"make": _quoted("make"), **{c: c for c in (
        "count", "valid_count", "min_year", "max_year", "min_price", "max_price")}, "label": _quoted("label")})} as json
    from summed
    """,
)
def _(t: Tables) -> DataFrame:
    return group_json(market.grouped_listings(part_listings(t), ["make"]))


@query(
    "search_groups_json",
    f"""
    with {PART_LISTINGS},
    grouped as (
      select make, count(*) as count, count(*) filter (where valid) as valid_count, 0 as chunk,
             '[' || string_agg(case when valid then {_CAR_JSON} else 'null' end, ',' order by year, cast(ad_number as varchar)) || ']' as cars
      from checked where year between 5 and 40 and price <= 1500 and make is distinct from 'Brand#2'
      group by make having count(*) >= 2)
    select {_json_sql({"make": _quoted("make"), "count": "count", "valid_count": "valid_count", "chunk": "chunk", "cars": "cars"})} as json
    from grouped
    """,
)
def _(t: Tables) -> DataFrame:
    # A search address and a make filter in, groups with their cars as JSON out.
    address = "https://ads.example/s?year_from=5&year_to=40&price_to=1500"
    return group_json(market.search_groups(part_listings(t), ["make"], address, exclude='{"brand#2": null}', min_count=2))


# --------------------------------------------------------------- scalar functions


@query(
    "normalize_name",
    """
    with named as (
      select p_partkey as id, 'p' as kind, upper(p_name) || '-3-series  gti' as name from part
      union all
      select c_custkey, 'c', replace(c_name, '#', '-') from customer)
    select id, kind, array_to_string(list_transform(string_split(replace(name, '-', ' '), ' '),
             lambda x: upper(x[1]) || lower(x[2:])), ' ') as name
    from named
    """,
)
def _(t: Tables) -> DataFrame:
    parts = t.part.select(
        F.col("p_partkey").alias("id"), F.lit("p").alias("kind"),
        F.concat(F.upper("p_name"), F.lit("-3-series  gti")).alias("name"),
    )
    customers = t.customer.select(
        F.col("c_custkey").alias("id"), F.lit("c").alias("kind"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"),
    )
    return parts.unionByName(customers).withColumn("name", X.normalize_name(F.col("name")))


@query(
    "snake_case",
    r"""
    with named as (
      select event_id, case event_type when 'click' then 'Click_Row' when 'view' then 'ABS'
             else event_type || upper(event_type[1]) || event_type[2:] || 'X' end as name
      from events)
    select event_id, case when contains(name, '_') then name when name = 'ABS' then 'a_b_s'
           else lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')) end as name
    from named
    """,
)
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.lit("Click_Row"))
        .when(kind == "view", F.lit("ABS"))
        .otherwise(F.concat(kind, F.initcap(kind), F.lit("X")))
    )
    return t.events.select("event_id", X.snake_case(name).alias("name"))


def dotted(number: Column) -> Column:
    """A whole number written with thousands dots."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("."))


@query(
    "number_cleanup",
    """
    select l_orderkey, l_linenumber,
           case when l_returnflag <> 'R' then cast(floor(l_extendedprice) as int) end as price,
           cast(floor(l_extendedprice * 10) as int) as mileage,
           cast(year(l_shipdate) as int) as year,
           case when l_linestatus = 'O' then cast(l_quantity as int) * 100 end as capacity,
           0 as no_capacity,
           cast(l_partkey as int) as power,
           case when l_linenumber > 3 then cast(l_suppkey as int) end as battery,
           l_linenumber = 2 as battery_bad,
           l_returnflag || ' ' || l_linestatus as trimmed
    from lineitem
    """,
)
def _(t: Tables) -> DataFrame:
    nbsp = " "
    price = F.floor("l_extendedprice")
    number = F.col("l_linenumber")
    battery = (
        F.when(number > 3, F.concat(F.lit(" "), "l_suppkey", F.lit(f"{nbsp}")))
        .when(number == 2, F.lit("oko 300"))
        .when(number == 1, F.lit(" "))
    )
    texts = PG.spread(t.lineitem).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("Po dogovoru"))
        .otherwise(F.concat(F.lit(f"{nbsp} "), dotted(price), F.lit(f"{nbsp}EUR")))
        .alias("price"),
        F.concat(dotted(F.floor(F.col("l_extendedprice") * 10)), F.lit(" km")).alias("mileage"),
        F.concat(F.year("l_shipdate"), F.lit(". ")).alias("year"),
        F.concat(
            F.col("l_quantity").cast("int") * 100,
            F.when(F.col("l_linestatus") == "O", F.lit("  cm3 ")).otherwise(F.lit(" l")),
        ).alias("capacity"),
        F.concat("l_partkey", F.lit(" /"), "l_suppkey", F.lit(" (kW/KS)")).alias("power"),
        battery.alias("battery"),
        F.concat(F.lit(f"\n\t{nbsp}"), "l_returnflag", F.lit(" "), "l_linestatus", F.lit(f"{nbsp} ")).alias("trimmed"),
    )
    return texts.select(
        "l_orderkey",
        "l_linenumber",
        X.dotted_int(F.col("price")).alias("price"),
        X.dotted_int(F.col("mileage")).alias("mileage"),
        X.year_number(F.col("year")).alias("year"),
        X.capacity_number(F.col("capacity")).alias("capacity"),
        X.capacity_number(F.lit(None).cast("string")).alias("no_capacity"),
        X.power_number(F.col("power")).alias("power"),
        X.plain_int(F.col("battery")).alias("battery"),
        X.optional_int_is_bad(F.col("battery")).alias("battery_bad"),
        X.strip_text(F.col("trimmed")).alias("trimmed"),
    )


@query(
    "url_path",
    r"select page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.url_path(F.col("url")).alias("path"))


@query(
    "url_number",
    r"""
    select page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') as bigint) as number,
           page_id as ad_number
    from pages
    """,
)
def _(t: Tables) -> DataFrame:
    link = F.concat(F.lit("https://ads.example/auto-oglasi/"), "page_id", F.lit("/x?attp=1"))
    return t.pages.select(
        "page_id",
        U.ad_number(U.url_path(F.col("url")), r"/(\d+)$").alias("number"),
        U.ad_number(U.url_path(link)).alias("ad_number"),
    )


@query(
    "url_params",
    r"""
    with parts as (
      select page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) as part from pages
      union all
      select page_id, unnest(['fuel[]=' || page_id, 'fuel[]=a b/ü', 'q=' || page_id]) from pages),
    named as (
      select page_id, split_part(part, '=', 1) as k, split_part(part, '=', 2) as v from parts where part like '%=_%')
    select page_id, k, count(*) > 1 or k like '%[]' as is_list, count(*) as n,
           array_to_string(list_sort(list(v)), '|') as vals
    from named group by page_id, k
    """,
)
def _(t: Tables) -> DataFrame:
    # The page's own parameters, and a few with escapes, repeats and blanks.
    query_text = F.concat(
        U.url_query(F.col("url")),
        F.lit("&fuel%5B%5D="), "page_id", F.lit("&blank=&fuel%5B%5D=a+b%2F%C3%BC&=&q="), "page_id",
    )
    rows = t.pages.select("page_id", F.explode(U.query_params(F.concat(F.lit("/s?"), query_text))).alias("k", "p"))
    return rows.select(
        "page_id", "k", F.col("p.is_list").alias("is_list"),
        F.size("p.values").cast("bigint").alias("n"),
        joined(F.sort_array("p.values"), "|").alias("vals"),
    )


@query(
    "url_set_param",
    r"""
    with cut as (
      select page_id, regexp_extract(url, '^([^?#]*)', 1) as base, regexp_extract(url, '\?([^#]*)', 1) as q,
             regexp_extract(url, '#(.*)$', 1) as frag from pages)
    select page_id,
           base || '?' || case when q = '' then 'page=9'
                when q like '%page=%' then regexp_replace(q, 'page=[^&]*', 'page=9')
                else q || '&page=9' end
           || case when frag <> '' then '#' || frag else '' end as url
    from cut
    """,
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.with_page_number(F.col("url"), F.lit(9)).alias("url"))


@query(
    "json_filters",
    """
    select event_id, event_type as make, cast(json_extract(props, '$.k') as varchar) as models from events
    """,
)
def _(t: Tables) -> DataFrame:
    number = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"'), "event_type", F.lit('": ["'), number, F.lit('"]}'))
    rows = t.events.select("event_id", F.explode(U.make_filters(text)).alias("make", "models"))
    return rows.select("event_id", "make", joined("models").alias("models"))


# -------------------------------------------------------------------- extraction


@query(
    "page_links",
    r"""
    with shown as (
      select page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') as html
      from pages),
    tags as (
      select page_id, unnest(regexp_extract_all(html, '<a [^>]*>')) as tag,
             generate_subscripts(regexp_extract_all(html, '<a [^>]*>'), 1) as seq
      from shown)
    select page_id, cast(seq - 1 as bigint) as seq,
           regexp_extract(regexp_extract(tag, 'href="([^"]*)"', 1), '^(?:https?://[^/?#]*)?([^?#]*)', 1) as path
    from tags
    """,
)
def _(t: Tables) -> DataFrame:
    links = M.tag_texts(M.visible_markup(F.col("html")), "a")
    rows = PG.spread(t.pages).select("page_id", F.posexplode(links).alias("seq", "tag"))
    return rows.select(
        "page_id", F.col("seq").cast("bigint").alias("seq"), U.url_path(M.attribute(F.col("tag"), "href")).alias("path")
    )


_UNESCAPED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(
    "page_fields",
    rf"""
    with shown as (
      select page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') as html
      from pages)
    select page_id,
           {_UNESCAPED.format("regexp_extract(html, '<title>([^<]*)', 1)")} as title,
           {_UNESCAPED.format("regexp_extract(html, '<h1>([^<]*)', 1)")} as h1,
           {_UNESCAPED.format("regexp_extract(html, '<div class=.ad.>([^<]*)', 1)")} as ad,
           {_UNESCAPED.format("array_to_string(regexp_extract_all(html, '<li>(?:<a[^>]*>)?([^<]*)', 1), '|')")} as words
    from shown
    """,
)
def _(t: Tables) -> DataFrame:
    shown = PG.spread(t.pages).select("page_id", M.visible_markup(F.col("html")).alias("html"))
    first_block = M.block_after(M.outline(F.col("html")), "^")
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li>(.*?)</li>"), 1)
    return shown.select(
        "page_id",
        M.first_element_text(F.col("html"), "title").alias("title"),
        M.first_element_text(F.col("html"), "h1").alias("h1"),
        F.coalesce(M.decode_entities(M.plain_text(first_block)), F.lit("")).alias("ad"),
        joined(F.transform(items, M.inner_text), "|").alias("words"),
    )


@query(
    "page_counter",
    """
    select o_orderkey as page_id, cast(o_custkey as int) as from_ad,
           cast(o_custkey + case when o_orderstatus = 'F' then 24 else 0 end as int) as to_ad,
           cast(case when o_totalprice >= 1000 then floor(floor(o_totalprice) / 1000) else floor(o_totalprice) end as int)
             as raw_total,
           cast(floor(o_totalprice) as int) as total,
           o_custkey + case when o_orderstatus = 'F' then 24 else 0 end = floor(o_totalprice) as is_last
    from orders
    """,
)
def _(t: Tables) -> DataFrame:
    last = F.col("o_custkey") + F.when(F.col("o_orderstatus") == "F", 24).otherwise(0)
    html = F.concat(
        F.lit('<h1 class="uk-h1 js-hide-on-filter">Oglasi</h1><div><!-- <small>7</small> --><small>Prikazano '),
        "o_custkey", F.lit(" do <b>"), last, F.lit("</b> od ukupno "),
        dotted(F.floor("o_totalprice")), F.lit("</small> <small>5</small></div>"),
    )
    counted = E.page_counter(PG.spread(t.orders).select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return counted.select("page_id", "from_ad", "to_ad", "raw_total", "total", "is_last")


@query(
    "page_window",
    """
    with last as (select o_custkey as run_id, min(o_orderkey) filter (where o_orderstatus = 'F') as page_no
                  from orders where o_orderkey >= 100 group by 1)
    select o_custkey as run_id, o_orderkey as page_no from orders join last on o_custkey = run_id
    where o_orderkey >= 100 and (last.page_no is null or o_orderkey <= last.page_no)
    """,
)
def _(t: Tables) -> DataFrame:
    pages = t.orders.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("page_no"),
        (F.col("o_orderstatus") == "F").alias("is_last"),
    )
    return PG.until_last_page(pages.where(PG.page_window(100))).select("run_id", "page_no")


def order_result_pages(t: Tables) -> DataFrame:
    """A result page per order: an ordinary ad, one that may be hidden or broken, other articles."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    image = F.when(status != "P", F.concat(F.lit('<img class="lazy lead" data-srcset="/img/'), key, F.lit('.jpg 1x">')))
    first = F.concat(
        F.lit('<article class="classified\n ad-'), key, F.lit(' uk-clearfix"><a class="x" href="/no">z</a>'),
        F.lit('<a title="a > b" class="firstImage uk-cover" href="/auto-oglasi/'), key, F.lit('/'),
        F.lower("o_orderpriority"), F.lit('?attp=1&amp;a=b">'), F.coalesce(image, F.lit("")),
        F.lit('</a><img class="lazy lead" data-srcset="other.jpg"></article>'),
    )
    hidden = F.when(status == "F", F.lit(" uk-hidden")).otherwise(F.lit(""))
    link = F.when(
        F.col("o_orderpriority") != "1-URGENT",
        F.concat(F.lit("<a class=firstImage href='/auto-oglasi/"), F.col("o_custkey"), F.lit("/kw'>q</a>")),
    )
    second = F.concat(
        F.lit('<article class="classified ad-'), F.col("o_custkey"), hidden, F.lit('"><div>'),
        F.coalesce(link, F.lit("")), F.lit("</div></article>"),
    )
    html = F.concat(
        F.lit("<html><!-- <article class='classified ad-1'></article> --><body>"), first,
        F.lit('<article class="classified"><a class="firstImage" href="/auto-oglasi/5/n"></a></article>'),
        second, F.lit("</body></html>"),
    )
    return PG.spread(t.orders).select(key.alias("page_id"), F.lit("/search").alias("url"), html.alias("html"))


@query(
    "result_page_ads",
    """
    select o_orderkey as page_id, cast(0 as bigint) as seq, o_orderkey as ad_number,
           '/auto-oglasi/' || o_orderkey || '/' || lower(o_orderpriority) as ad_link,
           case when o_orderstatus <> 'P' then '/img/' || o_orderkey || '.jpg 1x' end as img_link
    from orders
    union all
    select o_orderkey, 2, o_custkey, '/auto-oglasi/' || o_custkey || '/kw', null
    from orders where o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT'
    """,
)
def _(t: Tables) -> DataFrame:
    usable, _ = E.split_quarantine(E.page_ads(order_result_pages(t)))
    return usable.select("page_id", "seq", "ad_number", "ad_link", "img_link")


@query(
    "result_page_quarantine",
    """
    select o_orderkey as page_id, cast(2 as bigint) as seq, 'link_tag' as parse_error
    from orders where o_orderstatus <> 'F' and o_orderpriority = '1-URGENT'
    """,
)
def _(t: Tables) -> DataFrame:
    _, failed = E.split_quarantine(E.page_ads(order_result_pages(t)))
    return failed.select("page_id", "seq", joined("parse_error").alias("parse_error"))


def ad_page_html(fields: dict[str, Column], info: dict[str, Column], features: dict[str, Column], price: Column) -> Column:
    """An ad page with the given label values; a null value leaves its label out."""

    def pair(label: str, value: Column) -> Column:
        shown = F.concat(F.lit(f'<div class="row"><div>{label}</div><div class="v"> '), value, F.lit(" </div></div>"))
        return F.coalesce(shown, F.lit(""))

    def bare(label: str, value: Column) -> Column:
        # Names are not trimmed, so these come without spaces around them.
        return F.concat(F.lit(f"<p>{label}</p><span></span><div>"), value, F.lit("</div>"))

    untrimmed = {E.BASIC_LABELS["make"], E.BASIC_LABELS["model"]}
    basics = [bare(k, v) if k in untrimmed else pair(k, v) for k, v in fields.items()]
    lists = [
        F.concat(
            F.lit(f"<h3>{label}</h3><div><div class='clearfix'></div>"),
            F.array_join(
                F.transform(
                    values, lambda v: F.concat(F.lit('<div class="uk-width-medium-1-4"> '), v, F.lit("</div>"))
                ),
                "",
            ),
            F.lit("</div>"),
        )
        for label, values in features.items()
    ]
    return F.concat(
        F.lit('<!DOCTYPE html><html><head><script>var x="<div>Model</div>";</script></head><body>'),
        F.lit('<span class="priceClassified regularPriceColor"> '), price, F.lit("&nbsp;&euro;</span>"),
        F.lit('<div class="uk-grid classified-content" id="classified-content"><!-- <div>Marka</div> -->'),
        F.lit('<section class="js_fixedContetLoad uk-section">'), *basics, F.lit("</section>"),
        F.lit("<section><h2>Dodatne informacije</h2><div>"), *[pair(k, v) for k, v in info.items()],
        F.lit("</div></section>"), *lists, F.lit("</div></body></html>"),
    )


def _info_values() -> dict[str, Column]:
    same_for_all = {n: F.lit(f"{n} &amp; co") for n in E.INFO_LABELS}
    return {E.INFO_LABELS[n]: v for n, v in same_for_all.items()}


def part_ad_pages(t: Tables) -> DataFrame:
    """An ad page per part; promoted parts lack a required label, large ones have a bad number."""
    kind, size = F.col("p_type"), F.col("p_size")
    price = F.floor("p_retailprice")
    labels = E.BASIC_LABELS
    fields = {
        labels["make"]: F.lower("p_brand"),
        labels["model"]: F.replace("p_name", F.lit(" "), F.lit("-")),
        labels["condition"]: F.lit("<b>Polovno</b> vozilo"),
        labels["year"]: F.concat(size + 1970, F.lit(".")),
        labels["mileage"]: F.concat(dotted(F.col("p_partkey") * 10), F.lit(" km")),
        labels["body_type"]: kind,
        labels["fuel_type"]: F.lit("Di<div>z</div>el"),
        labels["engine_capacity"]: F.when(
            kind != "SMALL",
            F.concat(size * 40, F.when(kind == "LARGE", F.lit(" l")).otherwise(F.lit(" cm3"))),
        ),
        labels["engine_power"]: F.concat(size, F.lit("/"), size * 2, F.lit(" (kW/KS)")),
        labels["fixed_price"]: F.lit("DA"),
        labels["exchange"]: F.lit("NE"),
        labels["ad_number"]: F.col("p_partkey").cast("string"),
    }
    info = _info_values()
    info[E.INFO_LABELS["color"]] = F.when(kind != "PROMO", F.lit("Bela"))
    info["Broj vrata : "] = F.when(size > 10, F.lit("4/5 vrata"))
    info["Domet sa punom baterijom (km)"] = F.when(size > 40, size.cast("string"))
    features = {
        "Sigurnost": F.split("p_name", " "),
        "Oprema": F.array(kind, F.lit("A&amp;B")),
        "Stanje": F.array().cast("array<string>"),
    }
    return PG.spread(t.part).select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("/auto-oglasi/"), "p_partkey", F.lit("/x")).alias("url"),
        ad_page_html(fields, info, features, dotted(price)).alias("html"),
    )


@query(
    "ad_page_listings",
    """
    select p_partkey as page_id, p_partkey as ad_number, upper(p_brand[1]) || lower(p_brand[2:]) as make,
           array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as model,
           'Polovno vozilo' as condition, p_size + 1970 as year, cast(p_partkey * 10 as int) as mileage,
           p_type as body_type, 'Dizel' as fuel_type,
           case when p_type = 'SMALL' then 0 else p_size * 40 end as engine_capacity,
           p_size as engine_power, cast(floor(p_retailprice) as int) as price, 'DA' as fixed_price, 'NE' as exchange,
           'drive & co' as drive, 'Bela' as color, case when p_size > 10 then '4/5 vrata' end as doors,
           cast(null as varchar) as interior_color,
           case when p_size > 40 then p_size end as battery_range,
           replace(p_name, ' ', '|') as safety, p_type || '|A&B' as options, '' as details
    from part where p_type not in ('PROMO', 'LARGE')
    """,
)
def _(t: Tables) -> DataFrame:
    usable, _ = E.split_quarantine(E.ad_page_listings(part_ad_pages(t)))
    return usable.select(
        "page_id", "ad_number", "make", "model", "condition", "year", "mileage", "body_type", "fuel_type",
        "engine_capacity", "engine_power", "price", "fixed_price", "exchange", "drive", "color", "doors",
        "interior_color", "battery_range",
        *[joined(n, "|").alias(n) for n in E.FEATURE_LABELS],
    )


@query(
    "ad_page_quarantine",
    """
    select p_partkey as page_id, '/auto-oglasi/' || p_partkey || '/x' as url,
           case p_type when 'PROMO' then 'color' else 'engine_capacity' end as parse_error
    from part where p_type in ('PROMO', 'LARGE')
    """,
)
def _(t: Tables) -> DataFrame:
    _, failed = E.split_quarantine(E.ad_page_listings(part_ad_pages(t)))
    return failed.select("page_id", "url", joined("parse_error").alias("parse_error"))


@query(
    "quarantine",
    """
    select page_id, 'content,ad_number,make,model,year,mileage,engine_power,price,condition,body_type,fuel_type,'
        || 'fixed_price,exchange,drive,transmission,seats,steering_side,climate_control,color,origin,damage' as parse_error
    from pages
    """,
)
def _(t: Tables) -> DataFrame:
    # None of the raw pages is an ad page, so each is set aside and none stops the job.
    _, failed = E.split_quarantine(E.ad_page_listings(PG.spread(t.pages)))
    return failed.select("page_id", joined("parse_error").alias("parse_error"))


# -------------------------------------------------------------- lookups and joins


@query(
    "translate_codes",
    """
    select c_custkey, case when n_name <> 'NATION_5' then n_name end as label
    from customer left join nation on c_nationkey = n_nationkey
    """,
)
def _(t: Tables) -> DataFrame:
    dim = K.domain(nation_lookup(t, "origin").where("value <> 'NATION_5'"), "origin")
    rows = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    return K.translate(rows, "code", dim, "label").select("c_custkey", "label")


_TRANSLATED = """
    select c_custkey, coalesce(case when n_name <> 'NATION_5' then n_name end, '-') || ',-,'
           || coalesce(case when n_name <> 'NATION_5' then n_name end, '-') as codes
    from customer left join nation on c_nationkey = n_nationkey
"""


def _coded_customers(t: Tables) -> tuple[DataFrame, DataFrame]:
    dim = K.domain(nation_lookup(t, "origin").where("value <> 'NATION_5'"), "origin")
    code = F.col("c_nationkey").cast("string")
    return t.customer.select("c_custkey", F.array(code, F.lit("?"), code).alias("codes")), dim


def _flat_codes(rows: DataFrame) -> DataFrame:
    return rows.select("c_custkey", F.array_join("codes", ",", "-").alias("codes"))


@query("translate_lists", _TRANSLATED)
def _(t: Tables) -> DataFrame:
    rows, dim = _coded_customers(t)
    return _flat_codes(K.translate_list(rows, "codes", dim, by_join=False))


@query("translate_lists_joined", _TRANSLATED)
def _(t: Tables) -> DataFrame:
    rows, dim = _coded_customers(t)
    return _flat_codes(K.translate_list(rows, "codes", dim))


@query(
    "translate_lists_together",
    """
    select c_custkey, coalesce(case when n_name <> 'NATION_5' then n_name end, '-') || ',-' as nations,
           coalesce(case when c_mktsegment <> 'BUILDING' then 'S_' || c_mktsegment end, '-') || ',-,S_MACHINERY' as segments,
           case when c_custkey % 3 <> 0 then '' end as nothing
    from customer left join nation on c_nationkey = n_nationkey
    """,
)
def _(t: Tables) -> DataFrame:
    # Three list columns and their dimensions in one join; the third is empty or null.
    nations = K.domain(nation_lookup(t, "origin").where("value <> 'NATION_5'"), "origin")
    name = F.col("c_mktsegment")
    segments = t.customer.select(name.alias("key"), F.concat(F.lit("S_"), name).alias("value")).distinct().where("key <> 'BUILDING'")
    rows = t.customer.select(
        "c_custkey",
        F.array(F.col("c_nationkey").cast("string"), F.lit(None)).alias("nations"),
        F.array(name, F.lit("?"), F.lit("MACHINERY")).alias("segments"),
        F.when(F.col("c_custkey") % 3 != 0, F.array().cast("array<string>")).alias("nothing"),
    )
    found = K.translate_lists(rows, {"nations": nations, "segments": segments, "nothing": nations})
    return found.select("c_custkey", *[F.array_join(c, ",", "-").alias(c) for c in ("nations", "segments", "nothing")])


def event_sightings(t: Tables, events: DataFrame | None = None) -> DataFrame:
    events = t.events if events is None else events
    return events.select(
        F.col("user_id").alias("ad_number"),
        F.concat(F.lit("/auto-oglasi/"), "user_id", F.lit("/"), "event_type").alias("ad_link"),
        F.concat(F.lit("img/"), "event_id").alias("img_link"),
        F.to_date("ts").alias("page_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("seen_at"),
    )


SPLIT_DAY = "2024-01-02"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sightings after the first day, and the ads seen on the first day as stored ones."""
    seen = event_sightings(t)
    day = F.lit(SPLIT_DAY).cast("timestamp")
    return seen.where(F.col("seen_at") >= day), seen.where(F.col("seen_at") < day).select("ad_number").distinct()


def _split_sql(exists: str, order: str) -> str:
    return f"""
    with late as (
      select *, row_number() over (partition by user_id order by ts {order}, event_id {order}) as rn
      from events where ts >= timestamp '{SPLIT_DAY}')
    select user_id as ad_number, '/auto-oglasi/' || user_id || '/' || event_type as ad_link, event_id as seq,
           epoch_us(ts) as seen_us
    from late where rn = 1 and {exists} (
      select 1 from events e where e.user_id = late.user_id and e.ts < timestamp '{SPLIT_DAY}')
    """


@query("new_ads", _split_sql("not exists", "asc"))
def _(t: Tables) -> DataFrame:
    late, stored = _halves(t)
    return S.new_ads(late, stored).select("ad_number", "ad_link", "seq", F.unix_micros("seen_at").alias("seen_us"))


@query("known_ads", _split_sql("exists", "desc"))
def _(t: Tables) -> DataFrame:
    late, stored = _halves(t)
    return S.known_ads(late, stored).select("ad_number", "ad_link", "seq", F.unix_micros("seen_at").alias("seen_us"))


@query(
    "merge_short_detail",
    """
    select o_orderkey + case when l_returnflag = 'R' then 1 else 0 end as ad_number, '/o/' || o_orderkey as link,
           o_orderpriority as img_src, l_linenumber, l_quantity, l_returnflag = 'R' as number_mismatch
    from orders join lineitem on l_orderkey = o_orderkey
    """,
)
def _(t: Tables) -> DataFrame:
    short = t.orders.select(
        F.col("o_orderkey").alias("ad_number"),
        F.concat(F.lit("/o/"), "o_orderkey").alias("ad_link"),
        F.col("o_orderpriority").alias("img_link"),
    )
    own = F.col("l_orderkey") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    details = t.lineitem.select(
        F.col("l_orderkey").alias("sighted_number"), own.alias("ad_number"), "l_linenumber", "l_quantity"
    )
    return S.merge_short_and_details(short, details)


@query(
    "upsert_latest",
    """
    with newest as (
      select user_id, event_type, ts, event_id, value,
             row_number() over (partition by user_id order by ts desc, event_id desc) as rn
      from events)
    select coalesce(user_id, c_custkey) as ad_number, coalesce(event_type, c_mktsegment) as make,
           case when user_id is null then c_acctbal else value end as amount
    from customer full join (from newest where rn = 1) on c_custkey = user_id
    """,
)
def _(t: Tables) -> DataFrame:
    stored = t.customer.select(
        F.col("c_custkey").alias("ad_number"), F.col("c_mktsegment").alias("make"), F.col("c_acctbal").alias("amount"),
        F.lit(None).cast("timestamp").alias("updatedAt"), F.lit(None).cast("bigint").alias("seq"),
    )
    incoming = t.events.select(
        F.col("user_id").alias("ad_number"), F.col("event_type").alias("make"), F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("updatedAt"), F.col("event_id").alias("seq"),
    )
    merged = S.upsert(stored, incoming, order=("updatedAt", "seq"))
    return merged.select("ad_number", "make", "amount")


@query(
    "duplicate_keys",
    "select o_custkey as ad_number, count(*) as count from orders group by 1 having count(*) > 1",
)
def _(t: Tables) -> DataFrame:
    return S.duplicate_keys(t.orders.select(F.col("o_custkey").alias("ad_number")))


@query(
    "refresh_update",
    """
    with seen as (
      select o_custkey, o_orderkey, o_orderdate,
             row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
      from orders),
    last as (from seen where rn = 1)
    select c_custkey as ad_number, c_name as make,
           case when o_orderdate >= timestamp '2000-06-01' then '/o/' || o_orderkey end as ad_link,
           epoch_us(greatest(o_orderdate, timestamp '2000-06-01')) as updated_us
    from customer left join last on c_custkey = o_custkey
    """,
)
def _(t: Tables) -> DataFrame:
    stored = t.customer.select(
        F.col("c_custkey").alias("ad_number"), F.col("c_name").alias("make"),
        F.lit(None).cast("string").alias("ad_link"),
        F.lit("2000-06-01").cast("timestamp").alias("updatedAt"),
    )
    sightings = t.orders.select(
        F.col("o_custkey").alias("ad_number"), F.concat(F.lit("/o/"), "o_orderkey").alias("ad_link"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("seen_at"),
    )
    done = S.refresh(stored, sightings)
    return done.select("ad_number", "make", "ad_link", F.unix_micros("updatedAt").alias("updated_us"))


AS_OF = "2024-02-06 18:00:00"


@query(
    "retention",
    f"""
    select user_id as ad_number, epoch_us(max(ts)) as updated_us from events group by 1
    having max(ts) >= timestamp '{AS_OF}' - interval 7 days
    """,
)
def _(t: Tables) -> DataFrame:
    stored = event_sightings(t).groupBy("ad_number").agg(F.max("seen_at").alias("updatedAt"))
    kept = S.retain(stored, F.lit(AS_OF).cast("timestamp"))
    return kept.select("ad_number", F.unix_micros("updatedAt").alias("updated_us"))


def _lives_sql(gap: str) -> str:
    return f"""
    marked as (
      select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '{gap}'
                then 0 else 1 end as is_new
      from events),
    numbered as (select *, sum(is_new) over (partition by user_id order by ts, event_id) as life from marked)
    """


@query(
    "listing_lifetimes",
    f"""
    with {_lives_sql("8 hours")}
    select user_id as ad_number, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as updated_us,
           epoch_us(max(ts) + interval 8 hours) as expires_us, count(*) as sightings
    from numbered group by user_id, life
    """,
)
def _(t: Tables) -> DataFrame:
    lives = LT.lifetimes(event_sightings(t), gap_seconds=8 * 3600)
    return lives.select(
        "ad_number",
        F.unix_micros("createdAt").alias("created_us"),
        F.unix_micros("updatedAt").alias("updated_us"),
        F.unix_micros("expiresAt").alias("expires_us"),
        "sightings",
    )


@query(
    "run_stats",
    """
    with seen as (
      select cast(ts as date) as day, user_id = c_custkey and c_mktsegment = 'MACHINERY' as broken,
             row_number() over (partition by user_id order by ts, event_id) = 1 as is_first
      from events left join customer on user_id = c_custkey)
    select cast(day as varchar) as page_id,
           cast(sum(case when not broken and is_first then 1 else 0 end) as bigint) as inserted,
           cast(sum(case when broken then 1 else 0 end) as bigint) as failed,
           cast(sum(case when not broken and not is_first then 1 else 0 end) as bigint) as refreshed,
           cast(sum(case when broken or is_first then 1 else 0 end) as bigint) as attempted
    from seen group by day
    """,
)
def _(t: Tables) -> DataFrame:
    seen = event_sightings(t)
    first = S.first_sightings(seen).select(
        F.col("ad_number").alias("sighted_number"), F.col("page_id").alias("first_page")
    )
    fate = first.join(t.customer, F.col("sighted_number") == F.col("c_custkey")).select(
        "sighted_number", "first_page",
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("failed")).otherwise(F.lit("inserted")).alias("outcome"),
    )
    stats = S.outcome_counts(I.page_outcomes(seen, fate), ["page_id"])
    return stats.withColumn("page_id", F.col("page_id").cast("string"))


@query(
    "run_totals",
    """
    select o_custkey as run_id, count(distinct o_orderkey) as pages, cast(count(*) as bigint) as attempted,
           cast(sum(case when l_returnflag <> 'R' then 1 else 0 end) as bigint) as inserted,
           cast(0 as bigint) as refreshed, max(floor(o_totalprice)::int) as total_ads
    from orders join lineitem on l_orderkey = o_orderkey group by 1
    """,
)
def _(t: Tables) -> DataFrame:
    fate = F.when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise(F.lit("inserted"))
    per_page = S.outcome_counts(
        t.lineitem.select(F.col("l_orderkey").alias("page_id"), fate.alias("outcome")), ["page_id"]
    )
    runs = t.orders.select(
        F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("run_id"),
        F.floor("o_totalprice").cast("int").alias("total"),
    )
    return S.run_totals(per_page.join(runs, "page_id"), total="total")


# ---------------------------------------------------------------------- streaming

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_result_pages(events: DataFrame) -> DataFrame:
    """A result page per event, showing the user as an ad."""
    html = F.concat(
        F.lit('<article class="classified ad-'), "user_id", F.lit(' x"><a class="firstImage" href="/auto-oglasi/'),
        "user_id", F.lit("/"), "event_type", F.lit('?q=1"><img class="lazy lead" data-srcset="img/'), "event_id",
        F.lit('"></a></article>'),
    )
    return events.select(
        F.col("event_id").alias("page_id"), F.col("event_id").cast("int").alias("page_no"),
        F.lit("/search").alias("url"), html.alias("html"), F.col("ts").cast("timestamp").alias("seen_at"),
    )


def customer_ad_pages(t: Tables) -> DataFrame:
    """An ad page per customer; those of one segment lack a required label."""
    labels, key = E.BASIC_LABELS, F.col("c_custkey")
    fields = {
        labels["make"]: F.lower("c_mktsegment"),
        labels["model"]: F.replace("c_name", F.lit("#"), F.lit("-")),
        labels["condition"]: F.lit("Novo"),
        labels["year"]: F.concat(F.col("c_nationkey") + 2000, F.lit(".")),
        labels["mileage"]: F.lit("1.000 km"),
        labels["body_type"]: F.lit("Limuzina"),
        labels["fuel_type"]: F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("Dizel")),
        labels["engine_power"]: F.lit("110/150 (kW/KS)"),
        labels["fixed_price"]: F.lit("DA"),
        labels["exchange"]: F.lit("NE"),
        labels["ad_number"]: key.cast("string"),
    }
    html = ad_page_html(fields, _info_values(), {}, dotted(F.abs(F.floor("c_acctbal"))))
    return PG.spread(t.customer).select(
        key.alias("page_id"), F.concat(F.lit("/auto-oglasi/"), key, F.lit("/x")).alias("url"), html.alias("html")
    )


@query(
    "stream_ingest",
    f"""
    with {_lives_sql("8 hours")},
    lives as (
      select user_id, life, min(ts) as created, max(ts) as updated, count(*) as n,
             arg_min(event_type, (ts, event_id)) as first_type, arg_min(event_id, (ts, event_id)) as first_id,
             arg_max(event_type, (ts, event_id)) as last_type
      from numbered group by user_id, life),
    current as (select *, row_number() over (partition by user_id order by life desc) as rn from lives)
    select user_id as ad_number, '/auto-oglasi/' || user_id || '/' || first_type as link, 'img/' || first_id as img_src,
           case when n > 1 then '/auto-oglasi/' || user_id || '/' || last_type end as ad_link,
           upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as make, replace(c_name, '#', ' ') as model,
           c_nationkey + 2000 as year, cast(abs(floor(c_acctbal)) as int) as price, 0 as engine_capacity,
           epoch_us(created) as created_us, epoch_us(updated) as updated_us
    from current join customer on user_id = c_custkey
    where rn = 1 and c_mktsegment <> 'MACHINERY'
      and updated >= (select max(ts) from events) - interval 8 hours
    """,
)
def _(t: Tables) -> DataFrame:
    # The events come in six batches by time, so later ones meet stored, expired and revived ads.
    folder = shared_folder(t.spark, "stream-ingest")
    store = ListingSnapshots(t.spark, f"{folder}/listings", buckets=8, retention_days=8 / 24)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = t.events.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - first) * 6 / (last - first + 1))
    work = BatchIngest(store, details=details_from(customer_ad_pages(t)))
    for i in range(6):
        t.events.where(part == i).write.mode("append").parquet(f"{folder}/events")
        events = PG.stream_pages(t.spark, f"{folder}/events", EVENTS)
        start_ingest(event_result_pages(events), work, f"{folder}/checkpoint").awaitTermination()
    return store.read().select(
        "ad_number", "link", "img_src", "ad_link", "make", "model", "year", "price", "engine_capacity",
        F.unix_micros("createdAt").alias("created_us"), F.unix_micros("updatedAt").alias("updated_us"),
    )


def part_result_pages(t: Tables) -> DataFrame:
    """A result page per part, which shows the part as an ad."""
    key = F.col("p_partkey")
    html = F.concat(
        F.lit('<article class="classified ad-'), key, F.lit('"><a class="firstImage" href="/auto-oglasi/'), key,
        F.lit('/x"><img class="lazy lead" data-srcset="img/'), key, F.lit('"></a></article>'),
    )
    return t.part.select(
        key.alias("page_id"), key.cast("int").alias("page_no"), F.lit("/search").alias("url"), html.alias("html"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("seen_at"),
    )


_PART_WORDS = "string_split(p_name, ' ')"


@query(
    "ingest_coded_features",
    f"""
    with words as (select distinct unnest({_PART_WORDS}) as w from part),
    known as (select w, length(w) % 3 as kind from words),
    ads as (select p_partkey, p_type, {_PART_WORDS} as names from part where p_type not in ('PROMO', 'LARGE'))
    select p_partkey as ad_number,
           array_to_string(list_transform(names, lambda x: case when length(x) % 3 <> 0 then 'has_' || x else '-' end), '|') as safety,
           case when p_type = 'SMALL' then 'opt_small' else '-' end || '|opt_ab' as options
    from ads where list_contains(names, (select min(w) from known where kind = 1))
    """,
)
def _(t: Tables) -> DataFrame:
    # Pages to listings with coded features to a question about one of them; words of some lengths have no code.
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    known = words.withColumn("kind", F.length("w") % 3).where("kind != 0")
    lookups = known.select(F.lit("safety").alias("domain"), F.col("w").alias("key"), F.concat(F.lit("has_"), "w").alias("value"))
    options = t.spark.createDataFrame([("options", "SMALL", "opt_small"), ("options", "A&B", "opt_ab")], lookups.schema)
    lookups = lookups.unionByName(options)
    folder = shared_folder(t.spark, "coded-features")
    work = BatchIngest(ListingSnapshots(t.spark, f"{folder}/listings", buckets=8), details=details_from(part_ad_pages(t)), lookups=lookups)
    work(part_result_pages(t), 0)
    first = known.where("kind = 1").agg(F.min("w")).first()[0]
    wanted = facet_filter(f"https://ads.example/s?has_{first}=1", lookups)
    return work.store.read().where(wanted).select("ad_number", *[F.array_join(c, "|", "-").alias(c) for c in ("safety", "options")])


@query(
    "ingest_run",
    """
    with top as (select max(p_partkey) as total from part),
    last as (select min(p_partkey) as p, any_value(total) as total from part, top
             where p_partkey >= 10 and p_partkey * 10 >= total * 7)
    select 'parts' as run, cast(any_value(p) as int) as last_page, count(*) as pages, count(*) as attempted,
           count(*) filter (p_type not in ('PROMO', 'LARGE')) as inserted, cast(0 as bigint) as refreshed,
           count(*) filter (p_type in ('PROMO', 'LARGE')) as failed, cast(any_value(total) as int) as total_ads
    from part, last where p_partkey between 10 and p
    """,
)
def _(t: Tables) -> DataFrame:
    # A run from page 10 in two batches; the counters of the last three tenths say that theirs is the last page.
    total = t.part.agg(F.max("p_partkey").alias("total")).scalar()
    is_last = F.col("page_id") * 10 >= total * 7
    counter = F.concat(
        F.lit('<h1 class="uk-h1 js-hide-on-filter">Oglasi</h1><small>Prikazano 1 do '),
        F.when(is_last, total).otherwise(F.col("page_id") - 1), F.lit(" od ukupno "), dotted(total), F.lit("</small>"),
    )
    pages = part_result_pages(t).withColumn("html", F.concat(counter, "html"))
    pages = pages.withColumn("page_id", F.col("page_id").cast("long"))
    folder = shared_folder(t.spark, "ingest-run")
    store = ListingSnapshots(t.spark, f"{folder}/listings", buckets=8)
    work = BatchIngest(store, details=details_from(part_ad_pages(t)), run=PageRun("parts", start_page=10))
    for half in (F.col("page_id") * 2 < total, F.col("page_id") * 2 >= total):
        pages.where(half).write.mode("append").parquet(f"{folder}/pages")
        totals = await_run(start_ingest(PG.stream_pages(t.spark, f"{folder}/pages"), work, f"{folder}/checkpoint"), work)
    return totals


def _stream_to_table(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(t.spark, name)
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/rows")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("stream_first_seen", "select distinct user_id as ad_number from events")
def _(t: Tables) -> DataFrame:
    events = PG.stream_pages(t.spark, t.folder, EVENTS, glob="events.parquet")
    seen = first_seen(event_sightings(t, events), delay="60 days").select("ad_number")
    return _stream_to_table(t, seen, "stream-first-seen")


@query(
    "stream_ended_lives",
    f"""
    with {_lives_sql("8 hours")}
    select user_id as ad_number, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as updated_us,
           epoch_us(max(ts) + interval 8 hours) as expires_us, count(*) as sightings
    from numbered group by user_id, life
    having max(ts) + interval 8 hours <= (select max(ts) from events) - interval 1 hour
    """,
)
def _(t: Tables) -> DataFrame:
    events = PG.stream_pages(t.spark, t.folder, EVENTS, glob="events.parquet")
    lives = ended_lives(event_sightings(t, events), gap="8 hours", lateness="1 hour")
    ended = _stream_to_table(t, lives, "stream-lives")
    return ended.select(
        "ad_number", F.unix_micros("createdAt").alias("created_us"), F.unix_micros("updatedAt").alias("updated_us"),
        F.unix_micros("expiresAt").alias("expires_us"), "sightings",
    )
