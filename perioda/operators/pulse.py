"""Seconds an activity spent in each pulse zone.

An activity [start, end) needs, per zone, the sum of the samples inside it.
Instead of pairing samples with activities, both are laid on one time line
and the seconds are summed up along it; an activity is then the running sum
at its end minus the one at its start.  The work grows with samples plus
activities, even where activities overlap.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from perioda.functions.calendar import whole_seconds_between
from perioda.functions.fitness import ZONE_SHARES, zone_limits
from perioda.operators.ordered import MAX_GROUP_ROWS, arrange, carry_in
from perioda.schemas import HEART_ZONE_SECONDS


def secs_in_pulse_zones(
    activities: DataFrame,
    samples: DataFrame,
    *,
    keys: Sequence[str],
    plan: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """(keys, activity_id, secs_hr_zone0..5).

    ``activities``: keys, activity_id, dt (start), duration (seconds).
    ``samples``: keys, sample_id, ts, hr, birth_year.  ``keys`` name what a
    sample and an activity must share: the subject, or the subject and the
    day when each day is a document of its own.

    A sample counts the whole seconds since the sample before it on the same
    day, whether or not that one has a rate or lies in the activity; the
    first one of a day counts nothing.  Copies of a sample or an activity change
    nothing; an ``activity_id`` stands for one activity.  An activity without
    a start or a duration, or with a negative one, has null seconds.
    """
    keys = list(keys)
    lasts = F.coalesce(F.col("dt").isNotNull() & (F.col("duration") >= 0), F.lit(False))
    unknown = activities.filter(~lasts).select(*keys, "activity_id").distinct()
    activities = activities.filter(lasts)
    spans = activities.select(*keys, "activity_id", "dt", end_of_activity().alias("end"))
    known = secs_in_spans(spans, samples, keys=keys, plan=plan, max_group_rows=max_group_rows, block_rows=block_rows)
    return known.unionByName(unknown, allowMissingColumns=True)


def end_of_activity() -> Column:
    """The instant an activity (dt, duration) ends at."""
    return F.col("dt") + F.make_dt_interval(secs=F.col("duration").cast("decimal(18,6)"))


def secs_in_spans(
    spans: DataFrame,
    samples: DataFrame,
    *,
    keys: Sequence[str],
    plan: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """The same for ``spans``: keys, activity_id, dt, end, with dt <= end and neither null."""
    bounds = spans.select(
        *keys,
        "activity_id",
        F.explode(
            F.array(
                F.struct(F.col("dt").alias("at"), F.lit(-1).alias("sign")),
                F.struct(F.col("end").alias("at"), F.lit(1).alias("sign")),
            )
        ).alias("bound"),
    )
    # A bound goes before a sample of the same instant: start inclusive, end exclusive.
    line = bounds.select(
        *keys, "activity_id", F.col("bound.at").alias("at"), F.col("bound.sign").alias("sign"),
        F.lit(0).alias("kind"), F.col("activity_id").alias("row_id"),
    ).unionByName(
        samples.select(
            *keys, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("sample_id").alias("row_id"),
            F.col("hr").cast("bigint").alias("hr"), F.col("birth_year").cast("bigint").alias("birth_year"),
        ),
        allowMissingColumns=True,
    )
    arranged = arrange(
        line,
        keys,
        [F.col("at"), F.col("kind"), F.col("row_id"), F.col("sign")],
        plan=plan,
        max_group_rows=max_group_rows,
        block_rows=block_rows,
        drop_copies=True,
    )

    sample_at = F.when(F.col("kind") == 1, F.col("at"))
    arranged = carry_in(arranged, {"__last_at": (F.max(sample_at), F.max)})
    previous = F.coalesce(F.max(sample_at).over(arranged.before_here), F.col("__last_at"))
    timed = arranged.frame.withColumn("previous", previous)
    counts = (F.col("kind") == 1) & (F.to_date("previous") == F.to_date("at"))
    seconds = F.when(counts, whole_seconds_between(F.col("previous"), F.col("at"))).otherwise(F.lit(0))
    zoned = timed.withColumn("secs", seconds)

    year = F.year("at").cast("bigint")
    in_zone = {}
    for zone, name in zip(range(len(ZONE_SHARES)), HEART_ZONE_SECONDS):
        low, high = zone_limits(zone, F.col("birth_year"), year)
        inside = (F.col("hr") >= low) & (F.col("hr") < high)
        in_zone[name] = F.when(inside, F.col("secs")).otherwise(F.lit(0))
    zoned = zoned.withColumns(in_zone).drop("__last_at", "previous")

    arranged = carry_in(replace(arranged, frame=zoned), {f"__sum_{name}": (F.sum(name), F.sum) for name in in_zone})
    running = {
        name: F.coalesce(F.col(f"__sum_{name}"), F.lit(0)) + F.sum(name).over(arranged.up_to_here)
        for name in in_zone
    }
    at_bounds = arranged.frame.withColumns(running).filter(F.col("kind") == 0)
    at_start, at_end = F.col("sign") == -1, F.col("sign") == 1
    return at_bounds.groupBy(*keys, "activity_id").agg(
        *[
            (F.max(F.when(at_end, F.col(name))) - F.max(F.when(at_start, F.col(name)))).alias(name)
            for name in in_zone
        ]
    )
