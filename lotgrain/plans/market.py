"""The two questions asked of stored listings, from request to answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from lotgrain.operators import grouping as G
from lotgrain.operators.facets import facet_filter
from lotgrain.operators.labels import group_label


def grouped_listings(
    listings: DataFrame,
    group_by: Sequence[str],
    where: Column | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Filter, group, threshold, label, order: one shuffle on the keys, one for the order."""
    chosen = listings if where is None else listings.where(where)
    groups = G.group_summary(chosen, group_by, min_count)
    return G.order_groups(groups.withColumn("label", group_label(group_by)), group_by)


def search_groups(
    listings: DataFrame,
    group_by: Sequence[str],
    search_url: str | None = None,
    lookups: DataFrame | None = None,
    include: str | dict | None = None,
    exclude: str | dict | None = None,
    min_count: int = 1,
    sort_by: str = "year",
) -> DataFrame:
    """Groups with their members for a search address and make filters."""
    where = facet_filter(search_url, lookups, include, exclude)
    return G.group_members(listings.where(where), group_by, min_count, sort_by)


def make_dictionary(listings: DataFrame) -> DataFrame:
    """Makes with their distinct models, by make; a make with very many has several rows (``chunk``)."""
    return G.makes_models(listings).orderBy("make", "chunk").select("make", "chunk", "models")
