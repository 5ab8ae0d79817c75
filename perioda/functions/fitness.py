"""Formulas on distance, duration and pulse."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from perioda.functions.numeric import ratio, round_even

# Upper bounds in km (exclusive) and labels; anything else is the last label.
DISTANCE_BUCKETS = ((2.8, "<3km"), (5.8, "3-5km"), (10.0, "6-10km"))
LAST_BUCKET = ">10km"

# Zone 0 to 5 as shares of the highest pulse, which is 220 minus the age.
ZONE_SHARES = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0))
PULSE_AT_BIRTH = 220


def distance_bucket(kilometres: Column, null_bucket: str | None = LAST_BUCKET) -> Column:
    """Label of the distance; a missing distance gets ``null_bucket``."""
    label = F.when(kilometres.isNull(), F.lit(null_bucket))
    for limit, name in DISTANCE_BUCKETS:
        label = label.when(kilometres < limit, name)
    return label.otherwise(LAST_BUCKET)


def pace(duration: Column, distance: Column) -> Column:
    """Minutes per km from seconds and metres."""
    return ratio(duration / 60, distance / 1000)


def zone_limits(zone: int, birth_year: Column, year: Column) -> tuple[Column, Column]:
    """Lower (inclusive) and upper (exclusive) pulse of a zone in a given year."""
    highest = F.lit(PULSE_AT_BIRTH) - (year - birth_year)
    low, high = ZONE_SHARES[zone]
    return tuple(round_even(F.lit(share) * highest).cast("bigint") for share in (low, high))


def pulse_zones(birth_year: Column, year: Column) -> Column:
    """Array of {zone, low, high}, one element per zone."""
    return F.array(
        *[
            F.struct(F.lit(zone).cast("bigint").alias("zone"), low.alias("low"), high.alias("high"))
            for zone in range(len(ZONE_SHARES))
            for low, high in [zone_limits(zone, birth_year, year)]
        ]
    )
