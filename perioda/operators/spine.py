"""Every calendar day of a series, and the days without data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perioda.operators.ordered import null_safe_match, prefixed


def date_spine(df: DataFrame, as_of: dt.date, *, column: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """Days from the first one in the data up to, without, ``as_of``."""
    first = df.groupBy(*by).agg(F.to_date(F.min(column)).alias("first"))
    last = F.lit(as_of - dt.timedelta(days=1))
    return first.filter(F.col("first") <= last).select(*by, F.explode(F.sequence("first", last)).alias("day"))


def missing_days(df: DataFrame, as_of: dt.date, *, column: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """Days of the spine on which the series has no row."""
    keys = [*by, "day"]
    present = df.select(*by, F.to_date(column).alias("day")).distinct().select(*prefixed(keys, "__p_"))
    spine = date_spine(df, as_of, column=column, by=by)
    return spine.join(present, null_safe_match(keys, "__p_"), "left_anti")
