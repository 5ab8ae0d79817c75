"""From raw inputs to merged tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from perioda.functions import recode
from perioda.operators import align_merge, diagonal_merge, keep_one, merge_keep_existing, secs_in_pulse_zones
from perioda.schemas import HEART_ZONE_SECONDS, ZONE_SECONDS
from perioda.session import written
from perioda.sources.html import number
from perioda.sources.json import day_activities, day_pulse_samples, zone_columns

# Headings of the legacy table, codes of its activities, cut-offs.
LEGACY_COLUMNS = {
    "Träningsform": "form",
    "Minuter": "minutes",
    "Sekunder": "seconds",
    "Sträcka (km)": "km",
    "Kcal": "kcal",
    "Runda": "activity_name",
    "Datum": "date",
}
LEGACY_CODES = {"Löpning": "running", "Promenad": "walking"}
LEGACY_END = dt.datetime(2014, 10, 1)
REPAIR_END = dt.date(2015, 1, 1)
LEAST_DISTANCE = 1000


def zone_enrich(activities: DataFrame, zones: DataFrame) -> DataFrame:
    """Activities with ``secs_zone1..5`` from a table (activity_id, zones).

    The zone list is spread over columns in place, so the only shuffle is the
    join by id.  If an id was fetched twice, one of its lists is kept.
    """
    wide = zones.select("activity_id", *[c.alias(name) for name, c in zone_columns(F.col("zones")).items()])
    one = keep_one(wide, ["activity_id"], [F.col(name) for name in ZONE_SECONDS])
    return activities.join(one, "activity_id", "left")


def flatten_days(documents: DataFrame, *, time_zone: str = "UTC", **sizes: int) -> DataFrame:
    """Day documents -> activities with pulse zone seconds.

    Activities of a day without samples have null seconds.  The documents are
    parsed once and their typed rows written, since activities and samples
    are both taken from them, by more than one pass.
    """
    documents = written(documents, "day-documents")
    activities = day_activities(documents)
    samples = day_pulse_samples(documents, time_zone)
    keys = ["subject_id", "day"]
    pulse = secs_in_pulse_zones(activities, samples, keys=keys, **sizes)
    joined = activities.join(pulse, [*keys, "activity_id"], "left")
    shown = {name: F.when(F.col("has_pulse"), F.col(name)) for name in HEART_ZONE_SECONDS}
    return joined.withColumns(shown).drop("has_pulse", "day")


def ingest_activities(
    existing: DataFrame | None, documents: DataFrame, *, least: float = LEAST_DISTANCE, **sizes: int
) -> DataFrame:
    """Activities longer than ``least`` metres, merged into the existing ones."""
    fresh = flatten_days(documents, **sizes).filter(F.col("distance") > least)
    return fresh if existing is None else align_merge(existing, fresh)


def ingest_metrics(existing: DataFrame, samples: DataFrame) -> DataFrame:
    """Health samples merged into the existing ones; equal rows collapse."""
    return align_merge(existing, samples)


def legacy_activities(table: DataFrame) -> DataFrame:
    """Rows of the legacy HTML table (all text) -> activities up to its last day."""
    dated = table.select(
        F.col("date").cast("timestamp_ntz").alias("dt"),
        (number(F.col("km")) * 10).alias("distance"),
        (number(F.col("minutes")) * 60 + number(F.col("seconds"))).alias("duration"),
        number(F.col("kcal")).alias("calories"),
        recode(F.col("form"), LEGACY_CODES).alias("activity"),
    )
    last = F.lit(LEGACY_END.isoformat(sep=" ")).cast("timestamp_ntz")
    return dated.filter(F.col("activity").isNotNull() & (F.col("dt") <= last))


def quality_repair(
    activities: DataFrame,
    *,
    before: dt.date = REPAIR_END,
    small: float = 900,
    factor: float = 100,
    least_distance: float = 100,
    least_duration: float = 10,
    top_speed: float = 10,
) -> DataFrame:
    """Scale up the small distances of old rows, then drop what cannot be a workout."""
    old = (F.col("dt") <= F.lit(before)) & (F.col("distance") <= small)
    repaired = F.when(old, F.col("distance") * factor).otherwise(F.col("distance"))
    speed = F.try_divide("distance", "duration")
    return activities.withColumn("distance", repaired).filter(
        (F.col("distance") > least_distance) & (F.col("duration") > least_duration) & (speed <= top_speed)
    )


def ingest_legacy_activities(existing: DataFrame, table: DataFrame) -> DataFrame:
    return quality_repair(diagonal_merge(existing, legacy_activities(table)))


def ingest_gym_json(existing: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return diagonal_merge(existing, history)


def ingest_gym_csv(existing: DataFrame, logs: DataFrame, order: tuple[Column, ...] = ()) -> DataFrame:
    """One row per date, exercise and weight; existing rows win."""
    ties = order or (F.array_join("sets", ","),)
    return merge_keep_existing(existing, logs, ["dt", "exercise", "rep_max"], ties)
