"""Text forms of numbers and recoding of labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def minutes_clock(minutes: Column) -> Column:
    """Fractional minutes as ``m:ss``; both parts are cut, not rounded."""
    whole = minutes.cast("bigint")
    seconds = ((minutes - whole) * 60).cast("bigint")
    return F.concat(whole.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"))


def grouped_number(value: Column) -> Column:
    """Whole number, ties to even, with ``_`` between thousands."""
    return F.replace(F.format_number(F.bround(value), 0), F.lit(","), F.lit("_"))


def recode(label: Column, codes: Mapping[str, str]) -> Column:
    """Code of each label, null where the label is unknown."""
    pairs = [F.lit(part) for pair in codes.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), label)
