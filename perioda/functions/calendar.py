"""Calendar periods: labels are always the DATE on which the period starts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Accepted grain names.  "1m" means one minute where these
# names come from, which leaves every date as its own period.
GRAINS = {
    "none": "none",
    "1m": "none",
    "day": "day",
    "1d": "day",
    "dag": "day",
    "week": "week",
    "1w": "week",
    "vecka": "week",
    "month": "month",
    "1mo": "month",
    "månad": "month",
    "quarter": "quarter",
    "year": "year",
    "1y": "year",
    "år": "year",
}

# Month names on the year comparison.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "Maj", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dec")


def grain_name(grain: str) -> str:
    try:
        return GRAINS[grain]
    except KeyError:
        raise ValueError(f"unknown grain {grain!r}, expected one of {sorted(GRAINS)}") from None


def period_of(column: str | Column, grain: str) -> Column:
    """Start date of the period that holds ``column``; weeks start on Monday."""
    grain = grain_name(grain)
    day = F.to_date(F.col(column) if isinstance(column, str) else column)
    return day if grain in ("none", "day") else F.trunc(day, grain)


def next_period(day: dt.date, grain: str) -> dt.date:
    """First day after the period that holds ``day``."""
    grain = grain_name(grain)
    if grain in ("none", "day"):
        return day + dt.timedelta(days=1)
    if grain == "week":
        return day + dt.timedelta(days=7 - day.weekday())
    if grain == "year":
        return dt.date(day.year + 1, 1, 1)
    step = 1 if grain == "month" else 3
    months = (day.month - 1) // step * step + step
    return dt.date(day.year + months // 12, months % 12 + 1, 1)


def keep_range(
    df: DataFrame, start: dt.date | None, end: dt.date | None, column: str = "dt", end_inclusive_day: bool = False
) -> DataFrame:
    """Closed date range.

    On a timestamp column the end bound is midnight at the start of ``end``;
    ``end_inclusive_day`` keeps that whole day instead.
    """
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        if end_inclusive_day:
            df = df.filter(F.col(column) < F.lit(end + dt.timedelta(days=1)))
        else:
            df = df.filter(F.col(column) <= F.lit(end))
    return df


def keep_periods(
    df: DataFrame, start: dt.date | None, end: dt.date | None, grain: str, column: str = "dt"
) -> DataFrame:
    """Rows whose period start lies in the closed range.

    The same rows a filter on the aggregated period keeps: a first period cut
    by ``start`` drops out whole, the one that holds ``end`` stays whole.  A
    filter on a truncated date cannot reach the scan; this range on the raw
    column can.
    """
    if start is not None:
        first = start if _starts_period(start, grain) else next_period(start, grain)
        df = df.filter(F.col(column) >= F.lit(first))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(next_period(end, grain)))
    return df


def _starts_period(day: dt.date, grain: str) -> bool:
    return next_period(day - dt.timedelta(days=1), grain) == day


def calendar_year(column: str = "dt") -> Column:
    return F.year(column)


def calendar_month(column: str = "dt") -> Column:
    return F.month(column)


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), month.cast("int"))


def whole_seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from ``earlier`` to ``later``, fraction dropped, free of any time zone."""
    return (later - earlier).cast("interval second").cast("bigint")
