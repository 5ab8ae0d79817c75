"""JSON inputs: gym history and one document per day of activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from perioda.schemas import RAW_ACTIVITY, RAW_DAY, RAW_GYM, ZONE_SECONDS
from perioda.sources.json_arrays import read_json_array


def _to(value: Column, kind: str, on_error: str) -> Column:
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error is 'raise' or 'null', not {on_error!r}")
    return value.cast(kind) if on_error == "raise" else value.try_cast(kind)


def read_gym_json(spark: SparkSession, path: str, *, multi_line: bool = True, on_error: str = "raise") -> DataFrame:
    """Gym history files; ``multi_line`` for files that hold one array of records.

    Both these and files with one record per line are read in splits.
    """
    if multi_line:
        return gym_history(read_json_array(spark, path, RAW_GYM), on_error=on_error)
    raw = spark.read.schema(RAW_GYM).option("mode", "FAILFAST").json(path)
    return gym_history(raw, on_error=on_error)


def gym_history(raw: DataFrame, *, on_error: str = "raise") -> DataFrame:
    return raw.select(
        _to(F.col("date"), "date", on_error).alias("dt"),
        F.col("excercise").alias("exercise"),
        _to(F.col("rep_max"), "float", on_error).alias("rep_max"),
        "sets",
    )


def read_day_documents(
    spark: SparkSession, path: str, *, multi_line: bool = False, fields: T.StructType | str | None = None
) -> DataFrame:
    """Landed day payloads, one document per line or per file.

    ``fields`` are further fields of an activity in the payload, as a schema
    or in DDL; they stay with it as columns of their own name.
    """
    schema = day_schema(fields)
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def day_schema(fields: T.StructType | str | None = None) -> T.StructType:
    """RAW_DAY with further payload fields."""
    if fields is None:
        return RAW_DAY
    more = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    activity = T.StructType([*RAW_ACTIVITY.fields, *[f for f in more if f.name not in RAW_ACTIVITY.fieldNames()]])
    payload = T.StructType([T.StructField("payload", T.ArrayType(activity))])
    return T.StructType([T.StructField(f.name, payload) if f.name == "ActivitiesForDay" else f for f in RAW_DAY])


def further_fields(documents: DataFrame) -> list[str]:
    """Payload fields of ``documents`` beyond the declared ones."""
    activity = documents.schema["ActivitiesForDay"].dataType["payload"].dataType.elementType
    return [name for name in activity.fieldNames() if name not in RAW_ACTIVITY.fieldNames()]


def zone_columns(zones: Column) -> dict[str, Column]:
    """Zone list -> one column per zone; the first entry of a zone counts."""
    return {
        name: F.try_element_at(F.filter(zones, lambda z: z["zoneNumber"] == number), F.lit(1))["secsInZone"]
        for number, name in enumerate(ZONE_SECONDS, start=1)
    }


def day_activities(documents: DataFrame) -> DataFrame:
    """One row per activity, with all its payload fields; documents without activities give none."""
    # Whether there are samples is settled before the rows are spread, so no row carries them along.
    days = documents.select(
        F.col("subjectId").alias("subject_id"),
        (F.size("AllDayHR.payload.heartRateValues") > 0).alias("has_pulse"),
        F.col("ActivitiesForDay.payload").alias("payload"),
    )
    payload = days.select("subject_id", "has_pulse", F.explode("payload").alias("a"))
    more = {name: F.col("a")[name] for name in further_fields(documents)}
    return payload.select(*[value.alias(name) for name, value in activity_columns(F.col("a"), more)], "has_pulse")


def activity_columns(activity: Column, more: dict[str, Column]) -> list[tuple[str, Column]]:
    """Names and values of the columns of an activity, from its payload struct."""
    start = activity["startTimeLocal"].cast("timestamp_ntz")
    return [
        ("activity_id", activity["activityId"]),
        ("subject_id", F.col("subject_id")),
        ("dt", start),
        ("day", F.to_date(start)),
        ("activity", activity["activityType"]["typeKey"]),
        ("activity_name", activity["activityName"]),
        ("distance", activity["distance"]),
        ("duration", activity["duration"]),
        ("calories", activity["calories"]),
        ("steps", activity["steps"]),
        *zone_columns(activity["zones"]).items(),
        *more.items(),
    ]


def day_pulse_samples(documents: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """One row per heart rate sample, at the local time of ``time_zone``."""
    samples = documents.select(
        F.col("subjectId").alias("subject_id"),
        F.col("birthYear").alias("birth_year"),
        F.explode("AllDayHR.payload.heartRateValues").alias("s"),
    )
    at = F.convert_timezone(F.lit("UTC"), F.lit(time_zone), epoch_clock(F.col("s")[0]))
    rate = F.try_element_at("s", F.lit(2))
    return samples.select(
        "subject_id", "birth_year", at.alias("ts"), F.to_date(at).alias("day"),
        rate.alias("hr"), F.coalesce(rate, F.lit(-1)).alias("sample_id"),
    )


def epoch_clock(milliseconds: Column) -> Column:
    """UTC wall clock of an epoch time, independent of the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (milliseconds.cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,6)")
    return start + F.make_dt_interval(secs=seconds)
