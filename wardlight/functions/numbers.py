"""Exact rounding.

Ratios of counts and spans are rounded on integers, so a result never depends
on the order in which a shuffle happened to add floating-point numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column | int) -> Column:
    """An integer wide enough for products of sums."""
    return value.cast("decimal(38,0)") if isinstance(value, Column) else F.expr(f"cast({value} as decimal(38,0))")


def _div(left: Column, right: Column) -> Column:
    """Integer quotient cut toward zero."""
    return F.call_function("div", left, right)


def trunc_ratio(numerator: Column, denominator: Column, digits: int = 0) -> Column:
    """numerator / denominator cut toward zero after ``digits`` decimals (a double)."""
    scale = 10**digits
    quotient = _div(whole(numerator) * whole(scale), F.nullif(whole(denominator), whole(0)))
    return quotient.cast("double") / F.lit(float(scale))


def round_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator (positive) to the nearest integer, halves away from zero."""
    top, bottom = whole(numerator), F.nullif(whole(denominator), whole(0))
    size = _div(F.abs(top) * whole(2) + bottom, bottom * whole(2))
    return F.when(top < whole(0), -size).otherwise(size).cast("double")


def floor_ratio(numerator: Column, denominator: Column) -> Column:
    """Largest integer not above numerator / denominator (positive)."""
    top, bottom = whole(numerator), F.nullif(whole(denominator), whole(0))
    return _div(top - F.pmod(top, bottom), bottom).cast("bigint")


def fixed_text(value: Column, digits: int) -> Column:
    """``f"{value:.{digits}f}"`` of Python: rounded on the exact binary value, ties to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def python_round(value: Column, digits: int = 0) -> Column:
    """``round(value, digits)`` of Python, as a double."""
    return fixed_text(value, digits).cast("double")
