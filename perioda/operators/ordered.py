"""Windows over an ordered group, whatever the size of the group.

A plain window puts a whole group into one task.  ``arrange`` first measures
the largest group.  Up to ``MAX_GROUP_ROWS`` the plain window is kept: one
shuffle.  Beyond it the rows of the hot groups are range partitioned by
(group, order), so a hot group spreads over many even blocks; windows then
run inside a block, and ``carry_in`` brings what they need from the blocks
before.  The rows of all other groups take no detour.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from perioda.session import written

MAX_GROUP_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
BLOCK = "__block"


@dataclass(frozen=True)
class Arranged:
    frame: DataFrame
    group: tuple[str, ...]
    order: tuple[Column, ...]
    blocked: bool
    blocks: int = 0

    @property
    def keys(self) -> list[str]:
        return [*self.group, BLOCK] if self.blocked else list(self.group)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def up_to_here(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before_here(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)


def group_sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all); one row reaches the driver."""
    sizes = df.groupBy(*group).count()
    row = sizes.agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
    return row["largest"] or 0, row["total"] or 0


def width_of(df: DataFrame) -> Column:
    """Bytes of a row, about: texts by their length, all else by 16 a column."""
    size = lambda f: F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16
    known = (T.StringType, T.BinaryType)
    return sum((size(f) if isinstance(f.dataType, known) else F.lit(16) for f in df.schema), F.lit(16))


def few(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True if the rows of ``df``, a written table, are small enough to be sent to all."""
    return (df.agg(F.sum(width_of(df)).alias("bytes")).first()["bytes"] or 0) <= max_bytes


def split_hot(df: DataFrame, group: Sequence[str], max_group_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows of groups above the limit, all other rows, number of the former).

    At most total / max_group_rows groups can be above it.  Their keys are
    broadcast if they are small enough, so that rows are told apart without a
    shuffle, which would bring a hot group together.
    """
    sizes = df.groupBy(*group).count().filter(F.col("count") > max_group_rows)
    keys = written(sizes.select(*prefixed(group, "__h_"), F.col("count").alias("__rows")), "hot-groups")
    found = keys.agg(F.sum(width_of(keys)).alias("bytes"), F.sum("__rows").alias("rows")).first()
    if (found["bytes"] or 0) <= MAX_BROADCAST_BYTES:
        keys = F.broadcast(keys)
    is_hot = null_safe_match(group, "__h_")
    return df.join(keys, is_hot, "left_semi"), df.join(keys, is_hot, "left_anti"), found["rows"] or 0


def arrange(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    *,
    plan: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    block_rows: int | None = None,
    drop_copies: bool = False,
) -> Arranged:
    """Prepare ``df`` for windows over ``group`` in ``order``.

    ``order`` must be total within a group (end it with a unique column), so
    that every row has one place.  Where copies of a row mean nothing,
    ``drop_copies`` removes them before a hot group is cut into blocks; no
    cut could separate them.  ``plan`` is ``auto``, ``window`` (one task per
    group) or ``blocked`` (all groups in blocks).
    """
    if plan not in ("auto", "window", "blocked"):
        raise ValueError(f"unknown plan {plan!r}")
    if plan == "window":
        return Arranged(df, tuple(group), tuple(order), False)
    largest, total = group_sizes(df, group)
    if plan == "auto" and largest <= max_group_rows:
        return Arranged(df, tuple(group), tuple(order), False)

    # Read more than once from here on, so it is evaluated once and written.
    df = written(df, "ordered")
    hot, others, hot_rows = df, None, total
    if plan == "auto" and group:
        hot, others, hot_rows = split_hot(df, group, max_group_rows)
    if drop_copies:
        hot = hot.distinct()
    blocks = max(1, math.ceil(hot_rows / (block_rows or max_group_rows)))
    ranged = hot.repartitionByRange(blocks, *[F.col(name) for name in group], *order)
    # Written once: every later pass must see the same block numbers.
    frame = written(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")
    if others is not None:
        frame = frame.unionByName(others.withColumn(BLOCK, F.lit(-1)))
    return Arranged(frame, tuple(group), tuple(order), True, blocks)


def null_safe_match(keys: Sequence[str], prefix: str) -> Column:
    """Join condition ``key <=> prefix+key`` for every key."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return condition


def prefixed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(key).alias(f"{prefix}{key}") for key in keys]


def carry_in(
    arranged: Arranged,
    parts: Mapping[str, tuple[Column, Callable[[Column], Column]]],
    *,
    whole_group: Sequence[str] = (),
) -> Arranged:
    """Add what the earlier blocks of the same group hold.

    ``parts`` maps a new column to (aggregate within a block, how to combine
    the blocks before).  The column is null in a group's first block, and
    everywhere under the plain plan.  The columns named in ``whole_group``
    combine all blocks of the group instead; null where a group has one block.

    Only groups that span blocks need a carry.  With n range blocks those
    have at most 2(n-1) (group, block) pairs, so the side joined back is
    small however many groups there are, and groups kept whole have none.
    """
    if not arranged.blocked:
        empty = {name: F.lit(None) for name in parts}
        return replace(arranged, frame=arranged.frame.withColumns(empty))

    frame, keys = arranged.frame, arranged.keys
    in_blocks = frame.filter(F.col(BLOCK) >= 0)
    summary = in_blocks.groupBy(*keys).agg(*[part.alias(name) for name, (part, _) in parts.items()])
    blocks_of_group = Window.partitionBy(*arranged.group)
    before = blocks_of_group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__blocks", F.count("*").over(blocks_of_group)).filter("__blocks > 1")
    carried = summary.select(
        *prefixed(keys, "__r_"),
        *[
            combine(F.col(name)).over(blocks_of_group if name in whole_group else before).alias(name)
            for name, (_, combine) in parts.items()
        ],
    )
    carried = written(carried, "carried")
    if few(carried):
        carried = F.broadcast(carried)
    joined = frame.join(carried, null_safe_match(keys, "__r_"), "left")
    joined = joined.drop(*[f"__r_{key}" for key in keys])
    return replace(arranged, frame=joined)
