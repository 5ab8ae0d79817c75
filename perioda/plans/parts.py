"""Reports from stored daily parts, so that a merge makes only the touched years anew.

A part is what one day of one series adds to any report: rows, and of each
measure the sum, the number of values, the smallest and the largest.  Parts of
any period are parts again, so a report over them reads one row a day and
series instead of all rows.  Sums are never corrected by differences: a year
that was touched is made again, which reads no more than finding the
differences would and leaves no rounding behind.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perioda.functions import keep_periods, period_of, ratio, round_dp
from perioda.schemas import UNIT_PRICES
from perioda.sources.versions import read_version, refresh_derived

BILL_MEASURES = ("total_cost", "usage_kwh", "usage_mwh", *UNIT_PRICES, "heat_price")


def parts_schema(by: T.StructType, measures: Sequence[str]) -> T.StructType:
    """Columns of stored parts; ``by`` are the columns that tell series apart."""
    fields = [*by.fields, T.StructField("dt", T.DateType()), T.StructField("rows", T.LongType())]
    for name in measures:
        fields += [
            T.StructField(f"{name}_sum", T.DoubleType()), T.StructField(f"{name}_n", T.LongType()),
            T.StructField(f"{name}_low", T.DoubleType()), T.StructField(f"{name}_high", T.DoubleType()),
        ]
    return T.StructType(fields)


def daily_parts(rows: DataFrame, measures: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` and date; rows without a date share the date null."""
    made = [F.count("*").alias("rows")]
    for name in measures:
        value = F.col(name).cast("double")
        made += [
            F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n"),
            F.min(value).alias(f"{name}_low"), F.max(value).alias(f"{name}_high"),
        ]
    return rows.groupBy(*by, F.to_date("dt").alias("dt")).agg(*made)


def refresh_parts(
    spark: SparkSession, table: str, parts: str, schema: T.StructType, measures: Sequence[str], *, by: Sequence[str] = ()
) -> list[int]:
    """Bring the parts at ``parts`` up to the versioned table at ``table``; the years that were read."""
    return refresh_derived(spark, table, parts, schema, lambda rows: daily_parts(rows, measures, by=by))


def read_parts(spark: SparkSession, parts: str, by: T.StructType, measures: Sequence[str]) -> DataFrame:
    return read_version(spark, parts, parts_schema(by, measures))


def bounds_of_parts(parts: DataFrame, grain: str, measures: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, rows, and of each measure _mean, _low, _high)."""
    made = [F.sum("rows").alias("rows")]
    for name in measures:
        made += [
            ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(f"{name}_mean"),
            F.min(f"{name}_low").alias(f"{name}_low"), F.max(f"{name}_high").alias(f"{name}_high"),
        ]
    return parts.groupBy(*by, period_of("dt", grain).alias("period")).agg(*made)


def cost_of_parts(
    parts: DataFrame, grain: str, *, by: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """What ``bills.cost_by_period`` gives of the bills the parts were made from."""
    kept = keep_periods(parts, start, end, grain)
    total = lambda name: F.coalesce(F.sum(f"{name}_sum"), F.lit(0.0))
    mean = lambda name: ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))
    return kept.groupBy(*by, period_of("dt", grain).alias("period")).agg(
        total("total_cost").alias("total_cost"),
        round_dp(total("usage_kwh")).alias("usage_kwh"),
        round_dp(total("usage_mwh"), 2).alias("usage_mwh"),
        *[round_dp(mean(name), 2).alias(name) for name in (*UNIT_PRICES, "heat_price")],
    )


def coverage_of_parts(source: str, parts: DataFrame) -> DataFrame:
    """The row ``coverage.source_coverage`` gives of the source the parts were made from."""
    return parts.agg(
        F.lit(source).alias("source"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"),
        (F.year(F.max("dt")) - F.year(F.min("dt"))).cast("bigint").alias("years"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )
