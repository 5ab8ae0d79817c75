"""Quantiles from merged daily sketches against the exact ones."""

import bisect
import random

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from perioda.operators import daily_sketches, rank_error, sketched_quantiles
from perioda.plans import bills


@pytest.mark.parametrize("size,count", [(100, 30_000), (400, 30_000), (400, 300)])
def test_ranks_of_merged_sketches(make, size, count):
    rng = random.Random(count + size)
    values = [(k % 3, day(f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 29):02d}"), rng.lognormvariate(0, 2)) for k in range(count)]
    table = make(values, "who int, dt date, v double")
    parts = daily_sketches(table, ["v"], by=["who"], size=size)
    assert parts.count() <= 3 * 84
    for grain in ("month", "year"):
        found = sketched_quantiles(parts, {"low": ("v", 0.1), "mid": ("v", 0.5), "high": ("v", 0.9)}, grain, by=["who"], size=size).collect()
        assert len(found) == (9 if grain == "month" else 3)
        for r in found:
            own = sorted(v for who, d, v in values if who == r["who"] and (grain == "year" or d.month == r["period"].month))
            for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.9)):
                at = bisect.bisect_left(own, r[name])
                assert own[at] == r[name]
                assert abs((at + 0.5) / len(own) - share) <= 2 * rank_error(size) + 1 / len(own)


def test_small_groups_are_exact_and_nulls_are_left_out(make):
    table = make(
        [(day("2024-01-01"), 1.0), (day("2024-01-02"), 3.0), (day("2024-01-02"), None), (day("2024-01-03"), 2.0), (day("2024-02-01"), None),
         (day("2024-01-03"), float("nan"))],
        "dt date, v double",
    )
    parts = daily_sketches(table, ["v"])
    assert rows(sketched_quantiles(parts, {"mid": ("v", 0.5)}, "month")) == sorted([(day("2024-01-01"), 2.0), (day("2024-02-01"), None)], key=repr)
    assert sketched_quantiles(parts.limit(0), {"mid": ("v", 0.5)}, "year").count() == 0


def test_a_new_day_adds_its_own_sketch(make):
    old = make([(day("2024-01-01"), float(k)) for k in range(100)], "dt date, v double")
    new = make([(day("2024-01-02"), float(k)) for k in range(100, 201)], "dt date, v double")
    parts = daily_sketches(old, ["v"]).unionByName(daily_sketches(new, ["v"]))
    assert rows(sketched_quantiles(parts, {"mid": ("v", 0.5)}, "month"), "mid") == [(100.0,)]


def test_bills_without_an_id_differ_by_their_nulls(make):
    raw = make([("2024-01-01", None, 5.0), ("2024-01-01", 5.0, None)], "date string, `Elnät totalt belopp (kr)` double, `Elhandel totalt belopp (kr)` double")
    found = bills.from_invoices(raw, series_id=1)
    assert found.select(F.countDistinct("bill_id")).first()[0] == 2
