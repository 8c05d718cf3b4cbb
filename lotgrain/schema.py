"""Table layouts. Every column may be null unless the operator that writes it says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType(), True)

LISTINGS = T.StructType(
    [
        T.StructField("ad_number", T.LongType()),
        T.StructField("link", T.StringType()),
        T.StructField("img_src", T.StringType()),
        T.StructField("ad_link", T.StringType()),
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("mileage", T.IntegerType()),
        T.StructField("body_type", T.StringType()),
        T.StructField("fuel_type", T.StringType()),
        T.StructField("engine_capacity", T.IntegerType()),
        T.StructField("engine_power", T.IntegerType()),
        T.StructField("fixed_price", T.StringType()),
        T.StructField("price", T.IntegerType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("emission_class", T.StringType()),
        T.StructField("drive", T.StringType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("doors", T.StringType()),
        T.StructField("seats", T.StringType()),
        T.StructField("steering_side", T.StringType()),
        T.StructField("climate_control", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("interior_material", T.StringType()),
        T.StructField("interior_color", T.StringType()),
        T.StructField("registered_until", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("damage", T.StringType()),
        T.StructField("import_country", T.StringType()),
        T.StructField("sale_method", T.StringType()),
        T.StructField("battery_range", T.IntegerType()),
        T.StructField("safety", _STRINGS),
        T.StructField("options", _STRINGS),
        T.StructField("details", _STRINGS),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("updatedAt", T.TimestampType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# Result pages carry their number in the run and the time they were read.
RESULT_PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
    ]
)

SIGHTINGS = T.StructType(
    [
        T.StructField("ad_number", T.LongType()),
        T.StructField("ad_link", T.StringType()),
        T.StructField("img_link", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("seen_at", T.TimestampType()),
    ]
)

LOOKUPS = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# The fields of a grouped member, and those of them that must be present for it to be valid.
MEMBER_FIELDS = (
    "id", "link", "img_src", "make", "model", "year", "price", "engine_power", "engine_capacity",
)
REQUIRED_MEMBER_FIELDS = ("make", "model", "year", "price", "engine_power", "engine_capacity")
