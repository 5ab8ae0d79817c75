"""Health samples: blood pressure, weight and body fat per period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perioda.functions import keep_range, period_of, round_dp
from perioda.operators import fill_mean, pivot_values, rolling_mean, stack

# Metric name -> report column.
PRESSURE = {"bloodpressuresystolic": "systolic", "bloodpressurediastolic": "diastolic"}
WEIGHT_FAT = ("bodymass", "bodyfatpercentage")
LEAST_WEIGHT = 70


def _mean_of_days(
    metrics: DataFrame, names: Sequence[str] | dict[str, str], grain: str, by: Sequence[str]
) -> DataFrame:
    """Mean per day and metric, then the plain mean of those per period."""
    chosen = metrics.filter(F.col("metric").isin(list(names)))
    days = pivot_values(chosen, [*by, "dt"], "metric", names, F.avg("value"))
    columns = list(names.values()) if isinstance(names, dict) else list(names)
    return days.groupBy(*by, period_of("dt", grain).alias("period")).agg(*[F.avg(c).alias(c) for c in columns])


def bp_by_period(
    metrics: DataFrame,
    grain: str,
    *,
    by: Sequence[str] = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Mean systolic and diastolic pressure."""
    return _mean_of_days(keep_range(metrics, start, end), PRESSURE, grain, by)


def bp_extremes(pressure: DataFrame, *, by: Sequence[str] = (), rows: int = 5) -> DataFrame:
    """The periods with the highest and the lowest diastolic pressure.

    ``by`` columns are shown and break ties; they do not group.  Each end is a
    top-n that takes ``rows`` from every task; both read one shuffle of the
    aggregate before them, so that is made once.
    """
    known = pressure.filter(F.col("diastolic").isNotNull())
    shown = [*by, "period", *[round_dp(F.col(c), 1).alias(c) for c in ("systolic", "diastolic")]]
    ends = {"highest": F.col("diastolic").desc(), "lowest": F.col("diastolic").asc()}
    return stack(
        *[
            known.orderBy(order, "period", *by).limit(rows).select(F.lit(kind).alias("kind"), *shown)
            for kind, order in ends.items()
        ]
    )


def weight_fat_by_period(metrics: DataFrame, grain: str, *, by: Sequence[str] = ()) -> DataFrame:
    return _mean_of_days(metrics, WEIGHT_FAT, grain, by)


def weight_trend(
    weight_fat: DataFrame,
    *,
    by: Sequence[str] = (),
    least: float = LEAST_WEIGHT,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Weight smoothed over three periods; the open ends take the mean."""
    kept = keep_range(weight_fat.filter(F.col("bodymass") >= least), start, end, "period")
    smooth = kept.withColumn("smooth", rolling_mean(F.col("bodymass"), by=by, order="period"))
    return smooth.select(*by, "period", "bodymass", fill_mean(F.col("smooth"), by).alias("weight"))


def fat_trend(
    weight_fat: DataFrame, *, by: Sequence[str] = (), start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Body fat in percent, smoothed like the weight."""
    kept = keep_range(weight_fat, start, end, "period")
    percent = F.col("bodyfatpercentage") * 100
    smooth = kept.withColumn("smooth", rolling_mean(percent, by=by, order="period"))
    return smooth.select(*by, "period", "bodyfatpercentage", fill_mean(F.col("smooth"), by).alias("fat"))


def trend_bounds(trend: DataFrame, value: str, *, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Lowest and highest value of a trend's source column."""
    return trend.groupBy(*by).agg((F.min(value) * scale).alias("low"), (F.max(value) * scale).alias("high"))
