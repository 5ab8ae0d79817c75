"""Wide to long, long to wide, and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per id and value column."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot_values(
    df: DataFrame, index: Sequence[str], on: str, columns: Mapping[str, str] | Sequence[str], aggregate: Column
) -> DataFrame:
    """One column per listed value of ``on``.

    The list is explicit, which saves the pass that looks for the values and
    keeps a column for a value that does not occur.  A mapping renames.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {name: name for name in columns}
    wide = df.groupBy(*index).pivot(on, list(names)).agg(aggregate)
    return wide.select(*index, *[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{name}`").isNull()).alias(name) for name in df.columns])
    return counts.unpivot([], [f"`{name}`" for name in df.columns], "column_name", "nulls")
