"""Random inputs against plain Python, and laws that must hold."""

import csv
import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from perioda.functions import minutes_clock, period_of, round_dp, round_even
from perioda.functions.calendar import next_period
from perioda.operators import align_merge, diagonal_merge, merge_keep_existing, pivot_values, rolling_mean, to_long
from perioda.plans import activities as acts
from perioda.sources.sections import csv_cells


def test_csv_cells_like_the_csv_module(spark):
    rng = random.Random(1)
    pieces = ["a", "", "1.5", '"x"', '"a,b"', '"say ""hi"""', '""', " padded ", "å", "2024-01-01"]
    lines = [",".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(500)]
    found = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, line string")
    found = [r.cells for r in found.select("i", csv_cells(F.col("line")).alias("cells")).orderBy("i").collect()]
    for line, cells in zip(lines, found):
        expected = next(csv.reader([line])) or [""]
        assert [c or "" for c in cells] == expected


def test_periods_and_their_ends(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(days=3 * i) for i in range(260)]
    df = spark.createDataFrame([(d,) for d in days], "dt date")
    for grain in ("day", "week", "month", "quarter", "year"):
        for day, start in rows(df.select("dt", period_of("dt", grain).alias("p"))):
            assert start <= day < next_period(day, grain) and next_period(start, grain) == next_period(day, grain)
            if grain == "week":
                assert start.weekday() == 0


def test_rounding(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 1.005, 2.675, 1234.565, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [tuple(r) for r in df.select(round_dp(F.col("x")), round_even(F.col("x"))).collect()]
    assert [f[0] for f in found][:5] == [1.0, 2.0, 3.0, -1.0, -3.0]
    assert [f[1] for f in found] == [float(round(v)) for v in values]


def test_clock_like_python(spark):
    rng = random.Random(2)
    values = [rng.random() * 30 for _ in range(300)] + [0.0, 59.9999, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m double")
    found = [r.c for r in df.select("i", minutes_clock(F.col("m")).alias("c")).orderBy("i").collect()]
    assert found == [f"{int(v)}:{int((v - int(v)) * 60):02d}" for v in values]


def test_merges_repeat_without_effect(spark):
    rng = random.Random(3)
    rows_ = lambda n: [(rng.choice([1, 2, None]), rng.choice("ab"), float(rng.randrange(3))) for _ in range(n)]
    old, new = (spark.createDataFrame(rows_(60), "k int, n string, v double") for _ in range(2))
    keep = lambda a, b: merge_keep_existing(a, b, ["k", "n"], [F.col("v")])
    for merge in (align_merge, diagonal_merge, keep):
        once = merge(old, new)
        assert rows(merge(once, new)) == rows(once)
    assert rows(align_merge(old, new)) == rows(align_merge(new, old))
    assert rows(align_merge(old, new)) == rows(diagonal_merge(old, new))


def test_long_and_back(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 3 else 2.0 * i) for i in range(30)], "i int, a double, b double")
    long = to_long(df, ["i"], ["a", "b"], "name", "value")
    assert long.count() == 60
    assert rows(pivot_values(long, ["i"], "name", ["a", "b"], F.first("value"))) == rows(df)


def test_rolling_mean_like_python(spark):
    rng = random.Random(4)
    data = [(s, i, rng.choice([None, float(rng.randrange(20))] + [1.0, 2.0, 3.0])) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(data, "s int, i int, x double")
    for size in (3, 5):
        found = rows(df.select("s", "i", rolling_mean(F.col("x"), by=["s"], order="i", size=size).alias("m")))
        for s, i, mean in found:
            around = [x for t, j, x in data if t == s and abs(i - j) <= size // 2]
            whole = len(around) == size and None not in around
            assert (mean is None) != whole
            assert not whole or abs(mean - sum(around) / size) < 1e-12


def test_distance_labels_count_every_activity(spark):
    df = spark.range(500).select(
        F.lit("running").alias("activity"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("dt"),
        F.when(F.col("id") % 9 != 0, F.col("id") * 31.0).alias("distance"),
    )
    labels = acts.distance_buckets(df, "running", "month")
    assert labels.agg(F.sum("activity_count")).first()[0] == 500
