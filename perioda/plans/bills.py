"""Household bills: normalised rows, costs, consumption and prices per period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from perioda.functions import (
    calendar_month,
    calendar_year,
    grouped_number,
    keep_periods,
    month_label,
    period_of,
    ratio,
    round_dp,
    round_even,
)
from perioda.operators import diagonal_merge, keep_one, nan_to_null, to_long
from perioda.schemas import AMOUNTS, BILL_VALUES, INVOICE_COLUMNS, UNIT_PRICES

# Fees below the limit are stated without VAT.
FEE_LIMIT = 70
VAT_FACTOR = 1.25

SERIES = ("series_id",)
MEASURES = ("total_cost", "usage_kwh", "usage_mwh")


def from_invoices(raw: DataFrame, series_id: int | None = None, *, on_error: str = "raise") -> DataFrame:
    """Raw invoice table with the export's headings -> bills.

    Rows without a ``bill_id`` get one from their own content, in which nulls
    count: (null, 5) and (5, null) are different bills.
    """
    names = {old: new for old, new in INVOICE_COLUMNS.items() if old in raw.columns}
    bills = raw.withColumnsRenamed(names)
    if series_id is not None:
        bills = bills.withColumn("series_id", F.lit(series_id).cast("bigint"))
    if "bill_id" not in bills.columns:
        # The hash skips nulls, so it is said apart where they are.
        null = [F.col("`" + c.replace("`", "``") + "`").isNull() for c in bills.columns]
        bills = bills.withColumn("bill_id", F.xxhash64(*null, *["`" + c.replace("`", "``") + "`" for c in bills.columns]))
    day = F.col("date").cast("date") if on_error == "raise" else F.col("date").try_cast("date")
    return bills.withColumn("dt", day).drop("date")


def fee_with_vat(fee: Column) -> Column:
    return F.when(fee < FEE_LIMIT, fee * VAT_FACTOR).otherwise(fee)


def bill_total(bills: DataFrame) -> DataFrame:
    """Adds ``total_cost``, null if any part is null."""
    parts = [F.col(name) for name in AMOUNTS] + [fee_with_vat(F.col("service_fee"))]
    return bills.withColumn("total_cost", round_dp(reduce(Column.__add__, parts)))


def dedup_bills(bills: DataFrame, *, series: Sequence[str] = SERIES, tie: str = "bill_id") -> DataFrame:
    """One bill per series and date, the one with the lowest ``tie``."""
    return keep_one(bills, [*series, "dt"], [F.col(tie)])


def normalize_bills(
    bills: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    tie: str = "bill_id",
    recompute_total: bool = False,
    start: dt.date | None = None,
) -> DataFrame:
    """Total, NaN to null, backward fill, one row per series and date.

    Bills before ``start`` are left out.  The fill only looks ahead, so the
    later ones come out the same, and the bound reaches the scan.

    The total is taken before the fill, so a missing one is filled from the
    next bill; ``recompute_total`` adds up the filled parts instead.

    Filling rows in (dt, tie) order and then keeping the first row of a date
    gives, per column, the earliest non-null value of that date, else that of
    a later date.  So each date shrinks to one row first, by an aggregate
    that combines before the shuffle; the fill then runs over a series with
    at most one row per calendar date, however many bills it had.
    """
    values = [name for name in (*BILL_VALUES, "total_cost") if name in (*bills.columns, "total_cost")]
    if start is not None:
        bills = bills.filter(F.col("dt") >= F.lit(start))
    frame = nan_to_null(bill_total(bills.withColumn("dt", F.to_date("dt"))), values)
    dates = frame.groupBy(*series, "dt").agg(
        F.min(tie).alias(tie),
        *[F.min_by(name, F.when(F.col(name).isNotNull(), F.col(tie))).alias(name) for name in values],
    )
    later_first = Window.partitionBy(*series).orderBy(F.col("dt").desc())
    ahead = later_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = dates.withColumns({name: F.last(name, ignorenulls=True).over(ahead) for name in values})
    return bill_total(filled) if recompute_total else filled


def cost_by_period(
    bills: DataFrame,
    grain: str,
    *,
    by: Sequence[str] = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Cost and consumption summed, unit prices averaged, per period."""
    bills = keep_periods(bills, start, end, grain)
    zero = F.lit(0.0)
    return bills.groupBy(*by, period_of("dt", grain).alias("period")).agg(
        F.coalesce(F.sum("total_cost"), zero).alias("total_cost"),
        round_dp(F.coalesce(F.sum("usage_kwh"), zero)).alias("usage_kwh"),
        round_dp(F.coalesce(F.sum("usage_mwh"), zero), 2).alias("usage_mwh"),
        *[round_dp(F.avg(name), 2).alias(name) for name in (*UNIT_PRICES, "heat_price")],
    )


def consumption_by_period(bills: DataFrame, grain: str, *, by: Sequence[str] = ()) -> DataFrame:
    return cost_by_period(bills, grain, by=by).select(*by, "period", "usage_kwh", "usage_mwh")


def heat_price_by_period(bills: DataFrame, grain: str, *, by: Sequence[str] = ()) -> DataFrame:
    return cost_by_period(bills, grain, by=by).select(*by, "period", "heat_price")


def unit_price_long(bills: DataFrame, grain: str, *, by: Sequence[str] = ()) -> DataFrame:
    """(period, cost_type, cost): the five unit prices one below the other."""
    wide = cost_by_period(bills, grain, by=by)
    return to_long(wide, [*by, "period"], UNIT_PRICES, "cost_type", "cost")


def distinct_years(bills: DataFrame) -> DataFrame:
    return bills.select(calendar_year().alias("year")).distinct().orderBy("year")


def first_day_of(years: Sequence[int]) -> dt.date | None:
    return dt.date(min(years), 1, 1) if years else None


def first_day_shared(as_of: dt.date) -> dt.date:
    """The first day that ``cost_share`` counts."""
    return dt.date(as_of.year - 1, 1, 1)


def year_compare(bills: DataFrame, measure: str, years: Sequence[int], *, by: Sequence[str] = ()) -> DataFrame:
    """Bills of the chosen years as points (year, month, value); no year gives no rows.

    Normalise them with ``start=first_day_of(years)``, so that no earlier ones are read.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {MEASURES}, not {measure!r}")
    # One range per year instead of year(dt), so the scan can skip files.
    ranges = [F.col("dt").between(F.lit(dt.date(y, 1, 1)), F.lit(dt.date(y, 12, 31))) for y in sorted(set(years))]
    chosen = bills.filter(reduce(Column.__or__, ranges, F.lit(False)))
    month = calendar_month()
    return chosen.select(
        *by, "dt", calendar_year().alias("year"), month.alias("month"), month_label(month).alias("label"),
        F.col(measure).alias("value"),
    )


def cost_share(bills: DataFrame, as_of: dt.date, *, by: Sequence[str] = ()) -> DataFrame:
    """Last year's amounts by category, with their share of the sum in percent.

    Normalise the bills with ``start=first_day_shared(as_of)``, so that no earlier ones are read.
    """
    last = as_of.year - 1
    of_last_year = bills.filter(F.col("dt").between(F.lit(dt.date(last, 1, 1)), F.lit(dt.date(last, 12, 31))))
    sums = of_last_year.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in AMOUNTS])
    total = reduce(Column.__add__, [F.col(name) for name in AMOUNTS])
    long = to_long(sums.withColumn("total", total), [*by, "total"], AMOUNTS, "category", "amount")
    return long.select(
        *by, "category", "amount", (ratio(F.col("amount"), F.col("total")) * 100).alias("percentage"),
        grouped_number(F.col("amount")).alias("amount_text"),
    )


def month_forecast(bills: DataFrame, as_of: dt.date, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean total of the current calendar month over all years."""
    same_month = bills.filter(calendar_month() == as_of.month)
    return same_month.groupBy(*by).agg(round_even(F.avg("total_cost")).alias("forecast"))


def ingest_bills(existing: DataFrame, invoices: DataFrame, *, series: Sequence[str] = SERIES) -> DataFrame:
    """Normalised bills plus a normalised import, without copies."""
    return diagonal_merge(existing, normalize_bills(invoices, series=series))
