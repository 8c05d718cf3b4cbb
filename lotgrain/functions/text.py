"""Cleaning of label texts into names and numbers. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, no-break spaces included.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + (
    "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(text: Column) -> Column:
    """Trim white space of every kind."""
    return F.btrim(text, F.lit(WHITE))


def normalize_name(name: Column) -> Column:
    """Hyphens become spaces and every word is capitalised; spacing is kept as it is."""
    return F.initcap(F.regexp_replace(name, "-", " "))


def _plain_spaces(text: Column) -> Column:
    """Every kind of white space as a plain space, which keeps later patterns simple."""
    return F.translate(text, WHITE, " " * len(WHITE))


def whole_number(text: Column, as_type: str = "int") -> Column:
    """A whole number, or null. Testing first is much cheaper than a cast that fails."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast(as_type))


def dotted_int(text: Column) -> Column:
    """Leading number of a text such as ``8.500 EUR``, with thousands dots."""
    first = F.substring_index(F.trim(_plain_spaces(text)), " ", 1)
    return whole_number(F.replace(first, F.lit("."), F.lit("")))


def year_number(text: Column) -> Column:
    """A year that may be written with a final dot."""
    return whole_number(F.replace(strip_text(text), F.lit("."), F.lit("")))


def capacity_number(text: Column, unit: str = "cm3") -> Column:
    """``<int> cm3`` as an int; an absent text is 0, any other shape or unit is null."""
    number = F.regexp_extract(_plain_spaces(text), f"^ *([^ ]+) +{unit} *$", 1)
    return F.when(text.isNull(), F.lit(0)).otherwise(whole_number(number))


def power_number(text: Column) -> Column:
    """The number before the slash of ``110/150 (kW/KS)``."""
    return whole_number(strip_text(F.substring_index(text, "/", 1)))


def plain_int(text: Column) -> Column:
    return whole_number(strip_text(text))


def optional_int_is_bad(text: Column) -> Column:
    """True when an optional number is present, not blank, and not a number."""
    stripped = strip_text(text)
    return F.coalesce((stripped != "") & whole_number(stripped).isNull(), F.lit(False))


# Where a word of a camelCase name begins; the same for Java's and Python's expressions.
CAMEL_BORDER = r"(?<!^)(?=[A-Z])"


def snake_case(name: Column) -> Column:
    """camelCase to snake_case, for names without any underscore."""
    split_up = F.lower(F.regexp_replace(name, CAMEL_BORDER, "_"))
    return F.when(F.contains(name, F.lit("_")), name).otherwise(split_up)


def compact_strings(values: Column) -> Column:
    """Drop null elements; a missing array becomes an empty one."""
    return F.coalesce(F.array_compact(values), F.array().cast("array<string>"))
