"""Exact medians by a sketched bracket, where the sketch is far from exact."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from perioda.operators.median import exact_median


@pytest.mark.parametrize("kind", ["even", "ties", "skewed", "two", "sorted"])
def test_large_groups(spark, kind):
    value = {
        "even": F.rand(3) * 1e6, "ties": F.floor(F.rand(3) * 7), "skewed": F.exp(F.randn(3) * 5), "sorted": F.col("id") * 0.25,
        "two": F.when(F.col("id") % 3 == 0, -1e300).otherwise(1e300),
    }[kind]
    df = spark.range(300_000, numPartitions=16).select((F.col("id") % 13 == 0).alias("g"), value.cast("double").alias("v"))
    df = df.withColumn("w", F.when(F.col("v") > 0, -F.col("v")))
    found = {row["g"]: (row["m"], row["k"]) for row in exact_median(df, ["g"], {"m": "v", "k": "w"}).collect()}
    exact = df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"), F.percentile("w", 0.5).alias("k")).collect()
    for row in exact:
        for got, wanted in zip(found[row["g"]], (row["m"], row["k"])):
            assert got == pytest.approx(wanted, rel=1e-12)


def test_values_that_are_no_numbers_sort_last(make):
    nan, inf = math.nan, math.inf
    groups = {"a": [nan, 1.0, 2.0], "b": [nan, nan, 1.0], "c": [inf, nan, inf], "d": [None, None], "e": [-inf, 5.0, inf, None], "f": [-0.0, 0.0]}
    df = make([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    found = {row["g"]: row["m"] for row in exact_median(df, ["g"], {"m": "v"}).collect()}
    assert [found["a"], found["c"], found["d"], found["e"], found["f"]] == [2.0, inf, None, 5.0, 0.0] and math.isnan(found["b"])


def test_no_groups_and_no_rows(make):
    df = make([(float(k),) for k in range(10)], "v double")
    assert exact_median(df, [], {"m": "v"}).collect()[0]["m"] == 4.5
    assert exact_median(df.limit(0), [], {"m": "v"}).collect()[0]["m"] is None
    assert exact_median(df.limit(0).withColumn("g", F.lit(1)), ["g"], {"m": "v"}).count() == 0


def test_any_small_group(make):
    pick = random.Random(5)
    groups = {g: [pick.choice([0.0, 1.0, -2.5, 7.25, 1e9]) for _ in range(g % 9 + 1)] for g in range(200)}
    df = make([(g, v) for g, values in groups.items() for v in values], "g long, v double")
    found = {row["g"]: row["m"] for row in exact_median(df, ["g"], {"m": "v"}).collect()}
    assert found == {g: statistics.median(values) for g, values in groups.items()}
