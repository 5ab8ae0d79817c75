"""Workouts: counts, distances, pace, pulse zones and records."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perioda.functions import (
    distance_bucket,
    keep_periods,
    minutes_clock,
    pace,
    period_of,
    pulse_zones,
    round_dp,
)
from perioda.operators import exact_median, stack, to_long
from perioda.schemas import ZONE_SECONDS

# The band around 6 km, in metres.
SIX_KM_BAND = (5800, 6200)
WALK_METRIC = "distancewalkingrunning"


def activity_counts(activities: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return activities.groupBy(*by, "activity").agg(F.count("*").alias("count"))


def activity_types(activities: DataFrame) -> DataFrame:
    return activities.select("activity").distinct().orderBy("activity")


def distance_buckets(
    activities: DataFrame,
    activity: str,
    grain: str,
    *,
    by: Sequence[str] = (),
    null_bucket: str | None = ">10km",
) -> DataFrame:
    """Activities per period and distance label."""
    chosen = activities.filter(F.col("activity") == activity)
    label = distance_bucket(F.col("distance") / 1000, null_bucket)
    return chosen.groupBy(*by, period_of("dt", grain).alias("period"), label.alias("distance_range")).agg(
        F.count("activity").alias("activity_count")
    )


def active_days(
    df: DataFrame,
    category: str,
    grain: str,
    *,
    by: Sequence[str] = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Days with at least one row, per period."""
    days = keep_periods(df, start, end, grain).select(*by, F.to_date("dt").alias("day")).distinct()
    counts = days.groupBy(*by, period_of("day", grain).alias("period")).agg(F.count("*").alias("count"))
    return counts.withColumn("category", F.lit(category))


def active_days_by_kind(
    gym: DataFrame,
    activities: DataFrame,
    grain: str,
    *,
    activity: str = "running",
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Gym days and days with the activity, stacked."""
    runs = activities.filter(F.col("activity") == activity)
    return stack(
        active_days(gym, "gym", grain, start=start, end=end),
        active_days(runs, activity, grain, start=start, end=end),
    )


def walk_run_distance(
    metrics: DataFrame,
    activities: DataFrame,
    grain: str,
    *,
    activity: str = "running",
    by: Sequence[str] = (),
    resum: bool = True,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """(period, value in km, type): walked and run distance, stacked.

    The walking metric already holds running as well.  ``resum=False`` keeps
    one walk row per day, labelled with its period.
    """
    walked = keep_periods(metrics.filter(F.col("metric") == WALK_METRIC), start, end, grain)
    zero = F.lit(0.0)
    keys = [*by, period_of("dt", grain).alias("period")] + ([] if resum else ["dt"])
    walk = walked.groupBy(*keys).agg(F.coalesce(F.sum("value"), zero).alias("value"))
    walk = walk.select(*by, "period", "value", F.lit("walk").alias("type"))

    ran = keep_periods(activities.filter(F.col("activity") == activity), start, end, grain)
    run = ran.groupBy(*by, period_of("dt", grain).alias("period")).agg(
        (F.coalesce(F.sum("distance"), zero) / 1000).alias("value")
    )
    return stack(walk, run.withColumn("type", F.lit("run"))).orderBy("period", *by, "type")


def distance_histogram(activities: DataFrame, activity: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Activities per whole kilometre."""
    km = round_dp(F.col("distance") / 1000)
    chosen = activities.filter(F.col("activity") == activity)
    return chosen.groupBy(*by, km.alias("distance_km")).agg(F.count("*").alias("count")).orderBy(*by, "distance_km")


def pace_of(activities: DataFrame, activity: str, *keep: str) -> DataFrame:
    """(keep, dt, distance, mins_per_km) of one activity."""
    return activities.filter(F.col("activity") == activity).select(
        *keep, "dt", "distance", pace(F.col("duration"), F.col("distance")).alias("mins_per_km")
    )


def pace_by_period(
    activities: DataFrame, activity: str, grain: str, *, by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Median minutes per km."""
    paces = pace_of(activities, activity, *by).withColumn("period", period_of("dt", grain))
    return exact_median(paces, [*by, "period"], {"median_mins_per_km": "mins_per_km"}, approx=approx)


def pace_bounds(paces: DataFrame, *, by: Sequence[str] = (), pad: float = 0.5) -> DataFrame:
    """Lowest and highest median pace with room around them."""
    return paces.groupBy(*by).agg(
        (F.min("median_mins_per_km") - pad).alias("low"), (F.max("median_mins_per_km") + pad).alias("high")
    )


def pace_records(activities: DataFrame, activity: str, *, band: tuple[float, float] = SIX_KM_BAND) -> DataFrame:
    """(dt, pace as m:ss) of all activities in the distance band, fastest first."""
    low, high = band
    in_band = activities.filter(F.col("distance").between(low, high))
    paces = pace_of(in_band, activity, "activity_id")
    ordered = paces.orderBy("mins_per_km", "dt", "activity_id")
    return ordered.select("dt", minutes_clock(F.col("mins_per_km")).alias("pace"))


def longest_activities(activities: DataFrame) -> DataFrame:
    """(dt, km, activity) of all activities, longest first."""
    ordered = activities.select("dt", "distance", "activity", "activity_id").orderBy(
        F.col("distance").desc_nulls_first(), "dt", "activity_id"
    )
    return ordered.select("dt", round_dp(F.col("distance") / 1000).alias("km"), "activity")


def longest_runs(activities: DataFrame, *, activity: str = "running", rows: int = 10) -> DataFrame:
    """(km, duration, day) of the longest runs."""
    runs = activities.filter((F.col("activity") == activity) & F.col("distance").isNotNull())
    top = runs.orderBy(F.col("distance").desc(), "dt", "activity_id").limit(rows)
    return top.select(
        round_dp(F.col("distance") / 1000, 1).alias("km"),
        F.make_dt_interval(secs=F.col("duration").cast("decimal(18,6)")).alias("duration"),
        F.to_date("dt").alias("day"),
    )


def fastest_in_band(
    activities: DataFrame, *, activity: str = "running", band: tuple[float, float] = SIX_KM_BAND, rows: int = 10
) -> DataFrame:
    """(minutes, day) of the fastest runs in the distance band."""
    low, high = band
    runs = activities.filter(
        (F.col("activity") == activity) & F.col("distance").between(low, high) & F.col("duration").isNotNull()
    )
    minutes = round_dp(F.col("duration") / 60)
    top = runs.withColumn("minutes", minutes).orderBy("minutes", "dt", "activity_id").limit(rows)
    return top.select("minutes", F.to_date("dt").alias("day"))


def zone_medians(
    activities: DataFrame,
    activity: str,
    grain: str,
    *,
    by: Sequence[str] = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
    approx: bool = False,
) -> DataFrame:
    """Median minutes per pulse zone, one column per zone."""
    chosen = keep_periods(activities.filter(F.col("activity") == activity), start, end, grain)
    minutes = chosen.select(
        *by, period_of("dt", grain).alias("period"), *[(F.col(name) / 60).alias(name) for name in ZONE_SECONDS]
    )
    columns = {f"median_zone{n}": name for n, name in enumerate(ZONE_SECONDS, start=1)}
    return exact_median(minutes, [*by, "period"], columns, approx=approx)


def zone_medians_long(medians: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """(period, zone, median_time)."""
    names = [f"median_zone{n}" for n in range(1, len(ZONE_SECONDS) + 1)]
    return to_long(medians, [*by, "period"], names, "zone", "median_time")


def zone_bounds(people: DataFrame) -> DataFrame:
    """Pulse zones of every (birth_year, year) in ``people``."""
    pairs = people.select("birth_year", "year").distinct()
    zones = pairs.select("birth_year", "year", F.explode(pulse_zones(F.col("birth_year"), F.col("year"))).alias("z"))
    return zones.select("birth_year", "year", "z.zone", "z.low", "z.high")
