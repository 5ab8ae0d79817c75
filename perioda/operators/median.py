"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from perioda.operators.ordered import null_safe_match

#: The bracket around the middle, as a share of the rows on each side; only what lies in it is sorted.
MARGIN = 0.005
#: A sketch's ranks are off by at most 1 / ACCURACY of the rows, a tenth of the margin.
ACCURACY = 2000


def exact_median(df: DataFrame, group: Sequence[str], columns: Mapping[str, str], *, approx: bool = False) -> DataFrame:
    """Median per group of each column; ``columns`` maps output to input names.

    Numbers give doubles, intervals stay intervals.  Equal values shrink to
    one row each before they are moved.  A sketch of fixed size brackets the
    middle of each group; rows below the bracket are only counted, those above
    it are let go, and only what lies in it, about a hundredth of the rows, is
    sorted.  So no group has to fit a task, and the plan is the same for every
    size.  A bracket that missed the middle would raise.  ``df`` is evaluated
    twice.  ``approx`` stops at the sketch's value.
    """
    if approx:
        return df.groupBy(*group).agg(
            *[F.percentile_approx(source, 0.5).alias(name) for name, source in columns.items()]
        )
    kinds: dict[T.DataType, list[str]] = {}
    for name, source in columns.items():
        kind = df.schema[source].dataType
        kinds.setdefault(T.DoubleType() if isinstance(kind, T.NumericType) else kind, []).append(name)
    medians = [
        _of_one_type(df.select(*group, *[F.col(columns[n]).cast(kind).alias(n) for n in names]), group, names)
        for kind, names in kinds.items()
    ]
    together = reduce(lambda left, right: _beside(left, right, group), medians)
    return together.select(*group, *columns)


def _beside(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    if not group:
        return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one").drop("__one")
    named = right.withColumnsRenamed({key: f"__m_{key}" for key in group})
    return left.join(named, null_safe_match(group, "__m_")).drop(*[f"__m_{key}" for key in group])


def _of_one_type(df: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    series = [*group, "__column"]
    counted = df.unpivot(list(group), list(names), "__column", "__value")
    counted = counted.groupBy(*series, "__value").agg(F.count("__value").alias("__rows"))

    shares = F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN))
    endless, is_number = F.lit(float("inf")), isinstance(df.schema[names[0]].dataType, T.DoubleType)
    # A sketch has no place for values that are no numbers; they sort behind all others.
    sketched = lambda name: F.when(F.isnan(name), endless).otherwise(F.col(name)) if is_number else F.col(name)
    sketches = [
        F.struct(
            F.lit(name).alias("__column"),
            F.percentile_approx(sketched(name), shares, ACCURACY).alias("__cuts"),
            F.count(name).alias("__n"),
        ).alias(f"__of_{number}")
        for number, name in enumerate(names)
    ]
    brackets = df.groupBy(*group).agg(*sketches)
    brackets = brackets.select(*group, F.inline(F.array(*[f"__of_{number}" for number in range(len(names))])))
    brackets = brackets.withColumnsRenamed({key: f"__c_{key}" for key in series})

    held = counted.join(brackets, null_safe_match(series, "__c_"))
    low_cut, high_cut = F.col("__cuts")[0], F.col("__cuts")[1]
    above = F.col("__value") > high_cut
    if is_number:
        above = above & (high_cut < endless)
    # All rows below the bracket become one, which sorts first; a group of nulls keeps its place by it.
    kept = held.filter(~F.coalesce(above, F.lit(False)))
    kept = kept.withColumn("__value", F.when(F.col("__value") >= low_cut, F.col("__value")))
    kept = kept.groupBy(*series, "__n", "__value").agg(F.sum("__rows").alias("__rows"))
    if group:
        # Serves the window and the last aggregate.
        kept = kept.repartition(*[F.col(key) for key in group])
    up_to_here = Window.partitionBy(*series).orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = kept.withColumn("__last", F.sum("__rows").over(up_to_here))
    ranked = ranked.withColumn("__first", F.col("__last") - F.col("__rows"))
    # Zero-based ranks of the two middle rows.
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    holds = lambda rank: (F.col("__first") <= rank) & (rank < F.col("__last")) & F.col("__value").isNotNull()

    def median(name: str):
        of = F.col("__column") == name
        lower, upper = F.max(F.when(of & holds(low), F.col("__value"))), F.max(F.when(of & holds(high), F.col("__value")))
        missed = (lower.isNull() | upper.isNull()) & (F.max(F.when(of, F.col("__n"))) > 0)
        # Halves before the sum, so that two large values don't overflow.
        middle = F.when(lower == upper, lower).otherwise(lower * 0.5 + upper * 0.5)
        return F.when(missed, F.raise_error(F.lit(f"the bracket missed the median of {name}"))).otherwise(middle).alias(name)

    return ranked.groupBy(*group).agg(*map(median, names))
