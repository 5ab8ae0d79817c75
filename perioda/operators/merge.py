"""Union, de-duplication and merging of a new batch into existing rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _check_types(left: DataFrame, right: DataFrame, *, same_columns: bool) -> None:
    # Names of types leave out whether an element may be null.
    ours = {f.name: f.dataType.simpleString() for f in left.schema}
    theirs = {f.name: f.dataType.simpleString() for f in right.schema}
    if same_columns and set(ours) != set(theirs):
        raise ValueError(f"columns differ: {sorted(set(ours) ^ set(theirs))}")
    clash = [name for name in ours if name in theirs and ours[name] != theirs[name]]
    if clash:
        raise ValueError(f"types differ in columns {clash}")


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, which must have the same columns and types."""
    for other in frames[1:]:
        _check_types(frames[0], other, same_columns=True)
    return reduce(DataFrame.unionByName, frames)


def diagonal_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of both; a column one side lacks is null there."""
    _check_types(existing, new, same_columns=False)
    return existing.unionByName(new, allowMissingColumns=True).distinct()


def align_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join on all common columns, distinct; null keys match nothing.

    Equal columns make it a distinct union.  Otherwise copies go first, so a
    key repeated on both sides is paired once per different row, and rows
    with a null key, which would all hash to one task, skip the join.  The
    outer join runs as left join plus anti join: AQE can split a hot key in
    those, but not in a full outer join.
    """
    _check_types(existing, new, same_columns=False)
    common = [name for name in existing.columns if name in new.columns]
    if not common:
        raise ValueError("no common columns to align on")
    if set(existing.columns) == set(new.columns):
        return existing.unionByName(new).distinct()

    old, fresh = existing.distinct(), new.distinct()
    keyed = reduce(Column.__and__, [F.col(f"`{name}`").isNotNull() for name in common])
    old_keyed, fresh_keyed = old.filter(keyed), fresh.filter(keyed)
    matched = old_keyed.join(fresh_keyed, common, "left")
    only_new = fresh_keyed.join(old_keyed.select(*common), common, "left_anti")
    loose = old.filter(~keyed).unionByName(fresh.filter(~keyed), allowMissingColumns=True).distinct()
    return matched.unionByName(only_new, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``.

    Spark drops all but the first row of a key before the shuffle
    (WindowGroupLimit), so copies of a hot key never meet in one task.
    """
    return keep_first(df, keys, order, 1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows per key in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= rows).drop("__place")


def merge_keep_existing(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """One row per key; an existing row wins over a new one, then ``order`` decides."""
    both = stack(existing.withColumn("__new", F.lit(0)), new.withColumn("__new", F.lit(1)))
    return keep_one(both, keys, [F.col("__new"), *order]).drop("__new")
