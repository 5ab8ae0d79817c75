"""Pulse-zone seconds of activities while their samples still arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from perioda.operators.pulse import end_of_activity, secs_in_spans
from perioda.schemas import HEART_ZONE_SECONDS
from perioda.session import file_system, remove, written_for_now

# Kinds of rows on the time line; the last one is the latest closed sample of a key.
_ACTIVITY, _SAMPLE, _LAST = 0, 1, 2


def pulse_time_line(activities: DataFrame, samples: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """One stream of both, for ``stream_pulse_seconds``; columns as in ``secs_in_pulse_zones``."""
    lasts = F.col("dt").isNotNull() & (F.col("duration") >= 0)
    left = activities.select(
        *keys, F.lit(_ACTIVITY).alias("kind"), "activity_id", F.col("dt").alias("at"), F.when(lasts, end_of_activity()).alias("end")
    )
    right = samples.select(
        *keys, F.lit(_SAMPLE).alias("kind"), F.col("ts").alias("at"), "sample_id", F.col("hr").cast("bigint").alias("hr"),
        F.col("birth_year").cast("bigint").alias("birth_year"),
    )
    return left.unionByName(right, allowMissingColumns=True)


def stream_pulse_seconds(
    line: DataFrame, path: str, state: str, checkpoint: str, *, keys: Sequence[str], delay: str
) -> StreamingQuery:
    """Append the activities that have been answered since the last run to ``path``, then stop.

    The watermark is ``delay`` behind the latest time any batch so far has
    brought.  Once it has passed the end of an activity, no sample of it can
    come any more, and its seconds are handed on for good.  A sample, or an
    activity by its start, that comes behind the watermark of the batches
    before is late and left out; a repetition of what is closed is late too.
    So with a delay no shorter than rows may be late, the result is that of
    ``secs_in_pulse_zones`` over all rows, once later rows have moved the
    watermark past all ends.  An activity without a start or a duration, or
    with a negative one, is handed on with null seconds at once; a sample
    without a time is left out.

    What is carried from batch to batch is a table in ``state``: the samples
    and activities in front of the watermark, the sums so far of activities
    it stands in, and per key the last sample behind it, for as long as its
    day goes on.  A batch closes the piece of the time line between two
    watermarks: it cuts the activities to the piece and sums up as the batch
    operator does, hot keys included.  State and answers lie in a folder per
    batch, so a batch that is run again replaces its own.
    """
    keys = list(keys)

    def apply(batch: DataFrame, number: int) -> None:
        _close_piece(batch, number, path, state, keys, delay)

    return (
        line.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def answered(spark: SparkSession, path: str, schema: T.StructType, *, keys: Sequence[str]) -> DataFrame:
    """(keys, activity_id, secs_hr_zone0..5) handed on so far; ``schema`` is that of the time line."""
    columns = [*keys, "activity_id"]
    fields = [schema[name] for name in columns] + [T.StructField(name, T.LongType()) for name in HEART_ZONE_SECONDS]
    # Activities without seconds are not remembered, so a repetition of one may stand twice.
    return spark.read.schema(T.StructType(fields)).parquet(path).select(*columns, *HEART_ZONE_SECONDS).distinct()


def _close_piece(batch: DataFrame, number: int, path: str, state: str, keys: list[str], delay: str) -> None:
    spark = batch.sparkSession
    before = max((n for n in _batches(spark, state) if n < number), default=None)
    sums = {name: F.lit(None).cast("bigint") for name in HEART_ZONE_SECONDS}
    rows, time_type, mark, latest = batch.withColumns(sums), batch.schema["at"].dataType, None, None
    # Times go from batch to batch as text, which the driver cannot shift between zones.
    instant = lambda text: F.lit(text).cast(time_type)
    if before is not None:
        mark, latest = spark.read.parquet(f"{state}/batch={_name(before)}/mark").first()
        if mark is not None:
            rows = rows.filter(F.col("at").isNull() | (F.col("at") >= instant(mark)))
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{state}/batch={_name(before)}/rows"))
    rows = rows.filter((F.col("kind") != _SAMPLE) | F.col("at").isNotNull()).distinct()

    with written_for_now(rows, "pulse-line") as rows:
        arrived = rows.filter("kind <> 2").agg(F.max("at").alias("at"))
        seen = arrived.select(F.greatest("at", instant(latest)).alias("at"))
        reached = F.col("at") - F.expr(f"interval {delay}")
        # The watermark never goes back.
        new, latest = seen.select(F.greatest(reached, instant(mark)).cast("string"), F.col("at").cast("string")).first()
        is_activity, at_mark = F.col("kind") == _ACTIVITY, instant(new)
        has_end = F.col("end").isNotNull()
        closed = F.coalesce(F.col("at") < at_mark, F.lit(False))
        behind = rows.filter(~is_activity & closed)
        open_ = rows.filter(is_activity & has_end)

        pieces = open_.filter(closed).select(
            *keys, "activity_id", F.greatest("at", instant(mark)).alias("dt"), F.least("end", at_mark).alias("end")
        )
        timed = behind.select(*keys, F.col("at").alias("ts"), "sample_id", "hr", "birth_year")
        added = secs_in_spans(pieces, timed, keys=keys)
        so_far = open_.select(*keys, "activity_id", "at", "end", *HEART_ZONE_SECONDS)
        both = so_far.unionByName(added, allowMissingColumns=True)
        summed = both.groupBy(*keys, "activity_id").agg(
            F.max("at").alias("at"), F.max("end").alias("end"), *[F.sum(name).alias(name) for name in HEART_ZONE_SECONDS]
        )
        with written_for_now(summed, "pulse-sums") as summed:
            ended = F.coalesce(F.col("end") <= at_mark, F.lit(False))
            known = summed.filter(ended).select(
                *keys, "activity_id", *[F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name) for name in HEART_ZONE_SECONDS]
            )
            unknown = rows.filter(is_activity & ~has_end).select(*keys, "activity_id").distinct()
            answers = known.unionByName(unknown, allowMissingColumns=True)
            answers.write.mode("overwrite").parquet(f"{path}/batch={_name(number)}")

            last = behind.filter(F.to_date("at") == F.to_date(at_mark)).groupBy(*keys).agg(F.max("at").alias("at"))
            kept = (
                summed.filter(~ended).withColumn("kind", F.lit(_ACTIVITY))
                .unionByName(rows.filter((F.col("kind") == _SAMPLE) & ~closed), allowMissingColumns=True)
                .unionByName(last.withColumn("kind", F.lit(_LAST)), allowMissingColumns=True)
            )
            place = f"{state}/batch={_name(number)}"
            kept.select(*rows.columns).write.mode("overwrite").parquet(f"{place}/rows")
    marks = spark.range(1).select(F.lit(new).cast("string").alias("mark"), F.lit(latest).cast("string").alias("latest"))
    marks.coalesce(1).write.mode("overwrite").parquet(f"{place}/mark")
    # The batch before may be needed again only until this one is committed, which the next one shows.
    for old in _batches(spark, state):
        if before is not None and old < before:
            remove(spark, f"{state}/batch={_name(old)}")


def _name(number: int) -> str:
    return f"{number:09d}"


def _batches(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the batches whose state is whole: their mark is written last."""
    files, place = file_system(spark, state)
    if not files.exists(place):
        return []
    names = [status.getPath() for status in files.listStatus(place)]
    whole = [p for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "mark/_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)
