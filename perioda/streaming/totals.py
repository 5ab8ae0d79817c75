"""Daily totals from a stream whose rows come late, in any order, and more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from perioda.functions.calendar import period_of

#: Column that the watermark is kept on.
EVENT_TIME = "event_time"


def daily_totals(
    arrivals: DataFrame, values: Sequence[str], *, ids: Sequence[str], by: Sequence[str] = (), column: str = "dt", delay: str
) -> DataFrame:
    """(by, day, rows, total of each of ``values``) of a stream, each day once, when it is closed.

    The watermark is ``delay`` behind the latest time that an earlier batch
    has brought.  A row counts once: a repetition of its ``ids`` within the
    delay is dropped.  A day is closed, and handed on for good, as soon as the
    watermark has passed its end; a row that comes behind the watermark is
    late and left out.  So with a delay no shorter than the time rows may be
    late, the totals are those of a batch over all rows.  State holds the ids
    and the open days of the delay, and nothing older.  A row without a time
    is left out.
    """
    timed = arrivals.filter(F.col(column).isNotNull()).withColumn(EVENT_TIME, F.col(column).cast("timestamp"))
    once = timed.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark(list(ids))
    days = once.groupBy(*by, F.window(EVENT_TIME, "1 day").alias("window"))
    sums = days.agg(F.count("*").alias("rows"), *[F.sum(v).alias(v) for v in values])
    return sums.select(*by, F.to_date("window.start").alias("day"), "rows", *values)


def stream_daily_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the days that have been closed since the last run to the table at ``path``, then stop.

    The file sink takes each batch once, so a run that broke off may be repeated.
    """
    out = totals.writeStream.format("parquet").outputMode("append").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_by_period(
    spark: SparkSession, path: str, schema: T.StructType, values: Sequence[str], grain: str, *, by: Sequence[str] = ()
) -> DataFrame:
    """(by, period, rows, totals) from the closed days; nothing older is read again when days are added."""
    days = spark.read.schema(schema).parquet(path)
    period = period_of("day", grain).alias("period")
    return days.groupBy(*by, period).agg(F.sum("rows").alias("rows"), *[F.sum(v).alias(v) for v in values])
