"""Label and code translation against a dimension table (domain, key, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of at most so many keys together go to the rows as maps; some hundred kilobytes.
MAP_KEYS = 10_000


def domain(lookups: DataFrame, name: str) -> DataFrame:
    """Key and value of one domain, one row per key."""
    chosen = lookups.where(F.col("domain") == name)
    return chosen.groupBy("key").agg(F.max("value").alias("value"))


def translate(df: DataFrame, column: str, dim: DataFrame, into: str) -> DataFrame:
    """Add the value of a scalar code; unknown codes give null.

    The join carries no hint: Spark broadcasts the dimension only below its size threshold.
    """
    side = dim.select(F.col("key").alias("_key"), F.col("value").alias(into))
    return df.join(side, F.col(column) == F.col("_key"), "left").drop("_key")


def translate_lists(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Translate every element of some array columns, in place and in order, in one pass.

    ``dims`` has the dimension of each column. Unknown and null elements become null elements,
    repeats stay, a null array stays null. The elements of all columns meet all dimensions in a
    single join, so neither a dimension nor its size matters to the rows' own tasks.
    """
    # The row travels with its elements, so rows need no key of their own.
    numbered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.monotonically_increasing_id().alias("_id"))

    def named(c: str) -> Column:
        keys = F.coalesce(F.col("_row")[c], F.array().cast("array<string>"))
        return F.transform(keys, lambda x, i: F.struct(F.lit(c).alias("_list"), i.alias("_at"), x.alias("_key")))

    elements = numbered.select("_id", "_row", F.explode_outer(F.concat(*map(named, dims))).alias("_e")).select("_id", "_row", "_e.*")
    sides = [dim.select(F.lit(c).alias("_list"), F.col("key").alias("_key"), F.col("value").alias("_value")) for c, dim in dims.items()]
    side = reduce(DataFrame.unionAll, sides)
    lists = (
        elements.join(side, ["_list", "_key"], "left")
        .groupBy("_id")
        .agg(
            F.any_value("_row").alias("_row"),
            # One row per listing again: the arrays of one listing are bounded by its page.
            F.sort_array(F.collect_list(F.when(F.col("_list").isNotNull(), F.struct("_list", "_at", "_value")))).alias("_all"),
        )
    )

    def translated(c: str) -> Column:
        own = F.transform(F.filter("_all", lambda e: e["_list"] == c), lambda e: e["_value"])
        return F.when(F.col("_row")[c].isNotNull(), own)

    return lists.select(*[(translated(c) if c in dims else F.col("_row")[c]).alias(c) for c in df.columns])


def translate_list(df: DataFrame, column: str, dim: DataFrame, by_join: bool = True) -> DataFrame:
    """Translate every element of an array, in place and in order.

    Unknown elements become null elements, repeats stay, a null array stays null. Elements meet
    the dimension in a join; with ``by_join=False`` a dimension that the caller knows to be
    small is brought to the rows as one map, with the same answer.
    """
    if by_join:
        return translate_lists(df, {column: dim})
    codes = dim.where("key is not null").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")).scalar()
    named = df.withColumn("_codes", codes)
    return named.withColumn(column, F.transform(column, lambda x: named["_codes"][x])).select(*df.columns)


def translate_checked(df: DataFrame, dims: dict[str, DataFrame], max_keys: int = MAP_KEYS) -> DataFrame:
    """``translate_lists``, by maps where the dimensions are counted and found small, else by the join."""
    keys = reduce(DataFrame.unionAll, [d.select("key") for d in dims.values()])
    if keys.limit(max_keys + 1).count() > max_keys:
        return translate_lists(df, dims)
    for column, dim in dims.items():
        df = translate_list(df, column, dim, by_join=False)
    return df
