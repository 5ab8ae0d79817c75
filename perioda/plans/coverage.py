"""Which dates each source covers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from perioda.operators import stack


def source_coverage(sources: Mapping[str, DataFrame], column: str = "dt") -> DataFrame:
    """(source, first_day, last_day, years, rows), one row per source."""
    return stack(
        *[
            df.agg(
                F.lit(name).alias("source"),
                F.to_date(F.min(column)).alias("first_day"),
                F.to_date(F.max(column)).alias("last_day"),
                (F.year(F.max(column)) - F.year(F.min(column))).cast("bigint").alias("years"),
                F.count("*").alias("rows"),
            )
            for name, df in sources.items()
        ]
    )


def chosen_years(start: dt.date, end: dt.date) -> int:
    """Years the chosen range spans, at least one."""
    return end.year - start.year or 1
