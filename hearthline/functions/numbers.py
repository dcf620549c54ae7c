"""Tolerant casts and number formats, as column expressions.

Two casts of text disagree on the comma on purpose: whole() drops it, decimal() reads it as the decimal point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "[\\u00a0\\u202f ]"


def _finite(number: Column) -> Column:
    return F.nanvl(number, F.lit(None).cast("double"))


def double(plain: Column) -> Column:
    """Text as a double; what holds neither a digit nor a name of a number isn't cast, since each failing cast throws."""
    return F.when(plain.rlike("(?i)[0-9]|nan|inf"), plain.try_cast("double"))


def decimal(text: Column, default: Column | float | None = 0.0) -> Column:
    """Text (or a number) as a double: spaces dropped, comma as point; what isn't a number gives the default."""
    plain = F.regexp_replace(F.regexp_replace(text.cast("string"), _SPACES, ""), ",", ".")
    return F.coalesce(_finite(double(plain)), F.lit(default).cast("double"))


def whole(text: Column, default: Column | int | None = 0) -> Column:
    """Text (or a number) as a long, truncated: spaces and commas dropped; what isn't a number gives the default."""
    plain = F.regexp_replace(F.regexp_replace(text.cast("string"), _SPACES, ""), ",", "")
    number = _finite(double(plain))
    return F.coalesce(F.when(F.abs(number) < 9.2e18, number).cast("long"), F.lit(default).cast("long"))


def optional_decimal(text: Column) -> Column:
    """decimal() with null for what isn't a number."""
    return decimal(text, None)


def is_missing(value: Column) -> Column:
    """Null or blank text; zero is a value."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def half_even(value: Column) -> Column:
    """Round to whole, ties to even."""
    return F.bround(value, 0)


def clamp(value: Column, low: int = 0, high: int = 100) -> Column:
    """Rounded (ties to even) and held within [low, high], as an int."""
    return F.greatest(F.lit(low), F.least(F.lit(high), half_even(value))).cast("int")


def grouped(value: Column, suffix: str) -> Column:
    """1234567.8 -> '1 234 568' with the suffix."""
    return F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(" ")), F.lit(suffix))


def to_step(value: Column, step: int) -> Column:
    """To the nearest multiple, halves up."""
    return F.floor(value / step + 0.5) * step


def area(text: Column) -> Column:
    """Square metres from text such as '62,5 m²'; the first number that a metre sign follows."""
    return decimal(F.nullif(F.regexp_extract(text, r"(?iU)(\d+(?:[.,]\d+)?)\s*(?:m²|m2|kvm|kvadratmeter)", 1), F.lit("")), None)


def currency(text: Column) -> Column:
    """Whole kroner from text such as '3 117 502 kr'."""
    digits = F.regexp_replace(F.regexp_extract(text, r"(-?\d[\d\s  .]*)", 1), r"[^\d-]", "")
    return F.nullif(digits, F.lit("")).try_cast("long")
