"""Rolling statistics over period tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, functions as F


def rolling_mean(value: Column, *, by: Sequence[str], order: str, size: int = 3) -> Column:
    """Centred mean of ``size`` rows, null unless all of them are there and not null.

    Meant for tables with one row per key and period, where a group has no
    more rows than the calendar has periods.
    """
    if size % 2 == 0:
        raise ValueError("size must be odd to be centred")
    around = Window.partitionBy(*by).orderBy(order).rowsBetween(-(size // 2), size // 2)
    return F.when(F.count(value).over(around) == size, F.avg(value).over(around))
