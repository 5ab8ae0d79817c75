from perioda.functions.calendar import (
    GRAINS,
    calendar_month,
    calendar_year,
    keep_range,
    keep_periods,
    month_label,
    period_of,
    whole_seconds_between,
)
from perioda.functions.fitness import distance_bucket, pace, pulse_zones, zone_limits
from perioda.functions.numeric import ratio, round_dp, round_even
from perioda.functions.text import grouped_number, minutes_clock, recode

__all__ = [
    "GRAINS",
    "calendar_month",
    "calendar_year",
    "distance_bucket",
    "grouped_number",
    "keep_periods",
    "keep_range",
    "minutes_clock",
    "month_label",
    "pace",
    "period_of",
    "pulse_zones",
    "ratio",
    "recode",
    "round_dp",
    "round_even",
    "whole_seconds_between",
    "zone_limits",
]
