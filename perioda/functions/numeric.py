"""Rounding and division with one stated behaviour."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_dp(value: Column, places: int = 0) -> Column:
    """Round by scaling, ties away from zero."""
    if places == 0:
        return F.round(value)
    scale = float(10**places)
    return F.round(value * scale) / scale


def round_even(value: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.bround(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)
