"""Filter conditions as Columns. Each returns None when it is inactive, so callers can skip it.

Null rules: ranges, equality and all-of never match a missing value; the negations do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotgrain.functions.text import normalize_name

Bound = int | str | None
MakeModels = Mapping[str | None, Sequence[str] | None]


def in_range(column: str, low: Bound = None, high: Bound = None) -> Column | None:
    """Inclusive range with optional bounds.

    Inactive when both bounds are empty; one bound that is not a whole number switches the
    whole range off. A repeated parameter (a list) is an error.
    """
    for bound in (low, high):
        if isinstance(bound, (list, tuple)):
            raise ValueError(f"{column}: a range bound must be a single value")
    if not low and not high:
        return None
    try:
        low = None if low is None else int(low)
        high = None if high is None else int(high)
    except ValueError:
        return None
    sides = []
    if low is not None:
        sides.append(F.col(column) >= F.lit(low))
    if high is not None:
        sides.append(F.col(column) <= F.lit(high))
    return reduce(and_, sides)


def equals(column: str, value: object) -> Column | None:
    return F.col(column) == F.lit(value) if value else None


def one_of(column: str, values: Sequence[object]) -> Column | None:
    """Membership; a None in the list also matches missing values."""
    if not values:
        return None
    known = [v for v in values if v is not None]
    tests = [F.col(column).isin(known)] if known else []
    if len(known) < len(values):
        tests.append(F.col(column).isNull())
    return reduce(or_, tests)


def all_of(column: str, values: Sequence[str]) -> Column | None:
    """The array holds every value."""
    if not values:
        return None
    return reduce(and_, [F.array_contains(column, v) for v in dict.fromkeys(values)])


def _named(values: Iterable[str], normalize: Callable[[Column], Column]) -> list[Column]:
    return [normalize(F.lit(v)) for v in values]


def include_makes(
    makes: MakeModels | None,
    make: str = "make",
    model: str = "model",
    normalize: Callable[[Column], Column] = normalize_name,
) -> Column | None:
    """Any entry matches: the make, and one of its models where models are given."""
    clauses = []
    for name, models in (makes or {}).items():
        if not name:
            continue
        clause = F.col(make) == normalize(F.lit(name))
        if models:
            clause &= F.col(model).isin(_named(models, normalize))
        clauses.append(clause)
    return reduce(or_, clauses) if clauses else None


def exclude_makes(
    makes: MakeModels | None,
    make: str = "make",
    model: str = "model",
    normalize: Callable[[Column], Column] = normalize_name,
) -> Column | None:
    """No entry matches. An entry with models drops the whole make and also those model names
    under every other make; rows without a make or model survive."""
    clauses = []
    for name, models in (makes or {}).items():
        clause = ~F.col(make).eqNullSafe(normalize(F.lit(name)))
        if models:
            listed = F.col(model).isin(_named(models, normalize))
            clause &= F.col(model).isNull() | ~listed
        clauses.append(clause)
    return reduce(and_, clauses) if clauses else None


def all_active(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the active conditions, true when there are none."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))
