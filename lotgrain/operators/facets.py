"""Search parameters to one filter condition.

The parameters of a single request are a handful of strings, so they are read on the driver
with the standard library; the result is a Column that Catalyst pushes into the scan. For
columns of search addresses see ``lotgrain.functions.urls``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrain.functions.text import CAMEL_BORDER, normalize_name
from lotgrain.operators import predicates as P

Params = dict[str, str | list[str]]

# --- Fixed values: listing column -> names of the search parameters. ---
RANGE_PARAMS = {
    "price": ("price_from", "price_to"),
    "year": ("year_from", "year_to"),
    "engine_power": ("power_from", "power_to"),
    "engine_capacity": ("engine_volume_from", "engine_volume_to"),
    "mileage": ("mileage_from", "mileage_to"),
}
FEATURE_COLUMNS = ("safety", "options", "details")
ONE_OF_PARAMS = {
    "body_type": "chassis[]",
    "fuel_type": "fuel[]",
    "transmission": "gearbox[]",
    "climate_control": "air_condition[]",
    "damage": "damaged[]",
    "interior_material": "interior_material[]",
}
EQUALS_PARAMS = {
    "steering_side": "wheel_side",
    "emission_class": "emission_class",
}
MAKE_PARAMS = (("brand", "model[]"), ("brand2", "model2[]"))
# --- End of fixed values. ---


def snake_name(name: str) -> str:
    """camelCase parameter name to snake_case, unless it has an underscore already."""
    if "_" in name:
        return name
    return re.sub(CAMEL_BORDER, "_", name).lower()


def search_params(url: str | None) -> Params:
    """Parameters of a search address: lists for ``x[]`` and repeated keys, else strings."""
    found: Params = {}
    for key, values in parse_qs(urlsplit(url or "").query).items():
        found[key] = values[0] if len(values) == 1 and not key.endswith("[]") else values
    return found


def _code(facet: str, value: object) -> int:
    if isinstance(value, list):
        raise ValueError(f"{facet}: expected a single code")
    try:
        return int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{facet}: {value!r} is not a code") from None


def requested_codes(params: Params) -> dict[str, list[int]]:
    """Codes per facet column as they occur in the parameters."""
    asked = {}
    for facet, name in ONE_OF_PARAMS.items():
        asked[facet] = [_code(facet, v) for v in params.get(name) or []]
    for facet, name in EQUALS_PARAMS.items():
        asked[facet] = [_code(facet, params[name])] if params.get(name) else []
    return asked


class FacetLookup:
    """The part of a lookup table (domain, key, value) that one request needs.

    Code domains map a numeric key to the stored label; the three feature domains map a page
    label to a feature code. Only rows for the codes and names in the request are fetched, so
    what reaches the driver is bounded by the request, not by the table.
    """

    def __init__(self, labels: Mapping[tuple[str, int], str], features: Mapping[str, set[str]]):
        self.labels = dict(labels)
        self.features = {d: set(features.get(d, ())) for d in FEATURE_COLUMNS}

    @classmethod
    def empty(cls) -> FacetLookup:
        return cls({}, {})

    @classmethod
    def for_request(cls, lookups: DataFrame, params: Params) -> FacetLookup:
        asked = requested_codes(params)
        codes = [(facet, str(code)) for facet, found in asked.items() for code in found]
        names = [n for n in params if n]
        wanted = F.col("domain").isin(*FEATURE_COLUMNS) & F.col("value").isin(names)
        for facet, key in codes:
            wanted |= (F.col("domain") == facet) & (F.col("key") == key)
        is_feature = F.col("domain").isin(*FEATURE_COLUMNS)
        rows = (
            lookups.where(wanted)
            .groupBy("domain", F.when(is_feature, F.col("value")).otherwise(F.col("key")).alias("k"))
            .agg(F.max("value").alias("value"))
            .collect()
        )
        labels = {(r.domain, int(r.k)): r.value for r in rows if r.domain not in FEATURE_COLUMNS}
        features: dict[str, set[str]] = {}
        for r in rows:
            if r.domain in FEATURE_COLUMNS:
                features.setdefault(r.domain, set()).add(r.value)
        return cls(labels, features)


def url_makes(params: Params) -> dict[str | None, list[str] | None]:
    """Makes named in the search address; a make named twice keeps the later models."""
    makes: dict[str | None, list[str] | None] = {}
    for make_name, model_name in MAKE_PARAMS:
        make = params.get(make_name)
        if isinstance(make, list):
            raise ValueError(f"{make_name}: expected a single make")
        makes[make] = params.get(model_name)
    return makes


def facet_conditions(
    params: Params,
    lookup: FacetLookup,
    include: P.MakeModels | None = None,
    exclude: P.MakeModels | None = None,
    normalize: Callable[[Column], Column] = normalize_name,
) -> dict[str, Column | None]:
    """One entry per facet; None where the facet is not active."""
    params = {snake_name(k): v for k, v in params.items()}
    asked = requested_codes(params)
    conditions: dict[str, Column | None] = {
        column: P.in_range(column, params.get(low), params.get(high))
        for column, (low, high) in RANGE_PARAMS.items()
    }
    for column in FEATURE_COLUMNS:
        # Presence switches the filter on, whatever the value.
        conditions[column] = P.all_of(column, [n for n in params if n in lookup.features[column]])
    for column in ONE_OF_PARAMS:
        labels = [lookup.labels.get((column, code)) for code in asked[column]]
        conditions[column] = P.one_of(column, labels)
    for column in EQUALS_PARAMS:
        label = lookup.labels.get((column, asked[column][0])) if asked[column] else None
        conditions[column] = P.equals(column, label)
    wanted = {**(include or {}), **url_makes(params)}
    conditions["include"] = P.include_makes(wanted, normalize=normalize)
    conditions["exclude"] = P.exclude_makes(exclude, normalize=normalize)
    return conditions


def facet_filter(
    search_url: str | None = None,
    lookups: DataFrame | None = None,
    include: P.MakeModels | str | None = None,
    exclude: P.MakeModels | str | None = None,
    normalize: Callable[[Column], Column] = normalize_name,
) -> Column:
    """The whole search as one condition. ``include``/``exclude`` may be JSON texts."""
    include = json.loads(include) if isinstance(include, str) else include
    exclude = json.loads(exclude) if isinstance(exclude, str) else exclude
    params = search_params(search_url)
    named = {snake_name(k): v for k, v in params.items()}
    lookup = FacetLookup.empty() if lookups is None else FacetLookup.for_request(lookups, named)
    return P.all_active(facet_conditions(params, lookup, include, exclude, normalize).values())
