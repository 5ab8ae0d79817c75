from perioda.operators.fill import backfill, fill_mean, nan_to_null
from perioda.operators.median import exact_median
from perioda.operators.merge import align_merge, diagonal_merge, keep_one, merge_keep_existing, stack
from perioda.operators.ordered import arrange, carry_in
from perioda.operators.pulse import secs_in_pulse_zones
from perioda.operators.reshape import null_profile, pivot_values, to_long
from perioda.operators.rolling import rolling_mean
from perioda.operators.sketch import daily_sketches, rank_error, sketched_quantiles
from perioda.operators.spine import date_spine, missing_days

__all__ = [
    "align_merge",
    "arrange",
    "backfill",
    "carry_in",
    "daily_sketches",
    "date_spine",
    "diagonal_merge",
    "exact_median",
    "fill_mean",
    "keep_one",
    "merge_keep_existing",
    "missing_days",
    "nan_to_null",
    "null_profile",
    "pivot_values",
    "rank_error",
    "rolling_mean",
    "secs_in_pulse_zones",
    "sketched_quantiles",
    "stack",
    "to_long",
]
