"""Display texts for groups and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotgrain.functions.urls import absolute_url


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def year_range(count: str = "count", low: str = "min_year", high: str = "max_year") -> Column:
    single = (F.col(count) == 1) | (F.col(low) == F.col(high))
    return F.when(single, _text(low)).otherwise(F.concat(_text(low), F.lit("-"), _text(high)))


def price_range(low: str = "min_price", high: str = "max_price", currency: str = "EUR") -> Column:
    one = F.concat(F.lit(f"{currency} "), _text(low))
    two = F.concat(one, F.lit(f" - {currency} "), _text(high))
    return F.when(F.col(low) == F.col(high), one).otherwise(two)


def group_label(keys: Sequence[str]) -> Column:
    """``make [model ]years (count) - prices``; keys that were not grouped by are left out."""
    names = [F.when(F.col(k) != "", F.col(k)) for k in ("make", "model") if k in keys]
    counted = F.concat(F.lit("("), _text("count"), F.lit(")"))
    return F.concat_ws(" ", *names, year_range(), counted, F.lit("-"), price_range())


def listing_label(currency: str = "EUR") -> Column:
    """``make model - year (<capacity>cm3) - EUR price``."""
    return F.concat(
        F.col("make"), F.lit(" "), F.col("model"), F.lit(" - "), _text("year"),
        F.lit(" ("), _text("engine_capacity"), F.lit(f"cm3) - {currency} "), _text("price"),
    )


def listing_url(base: str, link: str = "link") -> Column:
    return absolute_url(base, F.col(link))
