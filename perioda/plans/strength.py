"""Strength training: counts and best lifts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from perioda.functions import period_of
from perioda.operators import pivot_values
from perioda.operators.merge import keep_first

# The exercises that are charted, and those with a record list.
CHARTED = ("Barbell Bench Press", "Barbell Squat", "Barbell Deadlift", "Barbell Preacher Curl")
RECORDS = ("Barbell Bench Press", "Barbell Squat")


def gym_counts(gym: DataFrame) -> DataFrame:
    """Rows per exercise, most frequent first."""
    return gym.groupBy("exercise").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "exercise")


def gym_max_wide(gym: DataFrame, exercises: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Best one-rep weight per month, one column per exercise.

    The best of a month is the best of its days, so one aggregate does.
    """
    months = gym.withColumn("month", period_of("dt", "month"))
    return pivot_values(months, ["month"], "exercise", exercises, F.max("rep_max"))


def gym_max_by_month(gym: DataFrame, exercises: Sequence[str] = CHARTED) -> DataFrame:
    """(month, exercise, rep_max) of the chosen exercises."""
    chosen = gym.filter(F.col("exercise").isin(list(exercises)))
    best = chosen.groupBy(period_of("dt", "month").alias("month"), "exercise").agg(F.max("rep_max").alias("rep_max"))
    return best.orderBy("month", "exercise")


def gym_best(gym: DataFrame, exercises: Sequence[str] = CHARTED) -> DataFrame:
    """Best weight ever per chosen exercise."""
    chosen = gym.filter(F.col("exercise").isin(list(exercises)))
    return chosen.groupBy("exercise").agg(F.max("rep_max").alias("rep_max"))


def gym_top(gym: DataFrame, exercises: Sequence[str] = RECORDS, *, rows: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """The best rows per exercise; sets without a weight do not count."""
    chosen = gym.filter(F.col("exercise").isin(list(exercises)) & F.col("rep_max").isNotNull())
    return keep_first(chosen, ["exercise"], [F.col("rep_max").desc(), F.col("dt"), *[F.col(t) for t in tie]], rows)


def period_slice(df: DataFrame, start_ms: int, end_ms: int, column: str = "dt") -> DataFrame:
    """Rows between two epoch times in milliseconds, both included."""
    zero = dt.datetime(1970, 1, 1)
    low, high = (
        F.lit((zero + dt.timedelta(milliseconds=ms)).isoformat(sep=" ")).cast("timestamp_ntz")
        for ms in (start_ms, end_ms)
    )
    return df.filter(F.col(column).between(low, high))
