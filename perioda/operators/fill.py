"""Missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from perioda.operators.ordered import BLOCK, MAX_GROUP_ROWS, arrange, carry_in


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in the floating columns (all of them by default)."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = floating if columns is None else [name for name in columns if name in floating]
    return df.withColumns({name: F.nanvl(F.col(name), F.lit(None)) for name in chosen}) if chosen else df


def backfill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    series: Sequence[str],
    order: str,
    tie: str,
    plan: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """Each null takes the next non-null value of its series.

    (``order``, ``tie``) must be unique within a series.  Rows are read from
    the last to the first: the running frame is linear, where one that looks
    ahead to the end of the group would be quadratic.
    """
    arranged = arrange(
        df,
        series,
        [F.col(order).desc(), F.col(tie).desc()],
        plan=plan,
        max_group_rows=max_group_rows,
        block_rows=block_rows,
    )
    place = F.struct(order, tie)
    # min_by skips rows without a place: the earliest value a block holds.
    heads = {
        f"__next_{name}": (
            F.min_by(name, F.when(F.col(name).isNotNull(), place)),
            partial(F.last, ignorenulls=True),
        )
        for name in columns
    }
    arranged = carry_in(arranged, heads)
    filled = {
        name: F.coalesce(F.last(name, ignorenulls=True).over(arranged.up_to_here), F.col(f"__next_{name}"))
        for name in columns
    }
    return arranged.frame.withColumns(filled).drop(BLOCK, *heads)


def fill_mean(value: Column, by: Sequence[str]) -> Column:
    """Null becomes the mean of the column; use on tables already cut to periods."""
    return F.coalesce(value, F.avg(value).over(Window.partitionBy(*by)))
