"""Plans for hot groups give the same rows as the plain ones."""

import random
import statistics

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from checks import adapters
from perioda.operators import arrange, backfill, carry_in, exact_median, secs_in_pulse_zones
from perioda.operators.ordered import group_sizes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sparse(spark):
    """One series holds most rows, most of those on one date, most values null."""
    rng = random.Random(7)
    data = []
    for number in range(1200):
        series = None if number % 40 == 0 else (1 if rng.random() < 0.7 else rng.randrange(2, 30))
        date = "2024-01-01" if rng.random() < 0.6 else f"2024-01-{rng.randrange(2, 29):02d}"
        value = float(rng.randrange(50)) if rng.random() < 0.05 else None
        data.append((series, number, at(date).date(), value, None if rng.random() < 0.99 else "x"))
    return spark.createDataFrame(data, "s int, id int, dt date, x double, y string").cache()


def brute_backfill(data):
    filled, following = [], {}
    for s, number, date, x, y in sorted(data, key=lambda r: (r[2], r[1]), reverse=True):
        carry = following.setdefault(s, [None, None])
        carry[:] = [carry[0] if x is None else x, carry[1] if y is None else y]
        filled.append((s, number, date, *carry))
    return sorted(filled, key=repr)


@pytest.mark.parametrize("block_rows", [37, 200, 5000])
def test_blocked_backfill(sparse, block_rows):
    expected = brute_backfill([tuple(r) for r in sparse.collect()])
    options = dict(series=["s"], order="dt", tie="id")
    blocked = backfill(sparse, ["x", "y"], plan="blocked", block_rows=block_rows, **options)
    assert rows(blocked, "s", "id", "dt", "x", "y") == expected
    assert rows(backfill(sparse, ["x", "y"], plan="window", **options)) == expected
    hot_only = backfill(sparse, ["x", "y"], max_group_rows=25, block_rows=block_rows, **options)
    assert rows(hot_only, "s", "id", "dt", "x", "y") == expected


def test_backfill_chooses_by_the_largest_group(sparse):
    assert group_sizes(sparse, ["s"])[1] == 1200
    order = [F.col("dt"), F.col("id")]
    assert not arrange(sparse, ["s"], order, max_group_rows=1200).blocked
    spread = arrange(sparse, ["s"], order, max_group_rows=100)
    assert spread.blocked
    # Only the hot series is cut.
    cut = spread.frame.filter("__block >= 0").select("s").distinct()
    assert [r.s for r in cut.collect()] == [1] and spread.frame.count() == 1200
    # No block is much larger than asked for, though one series and one date hold most rows.
    assert spread.frame.groupBy(*spread.keys).count().agg(F.max("count")).first()[0] < 300


def test_carry_joins_only_groups_that_span_blocks(sparse):
    spread = arrange(sparse, ["s"], [F.col("dt"), F.col("id")], plan="blocked", block_rows=100)
    summed = carry_in(spread, {"before": (F.count("*"), F.sum)}).frame
    first = summed.filter(F.col("before").isNull()).select("s", "__block").distinct()
    assert first.count() == sparse.select("s").distinct().count()


def test_one_series_without_a_key(sparse):
    options = dict(series=[], order="dt", tie="id")
    whole = backfill(sparse, ["x"], plan="window", **options)
    assert rows(backfill(sparse, ["x"], plan="blocked", block_rows=100, **options)) == rows(whole)


@pytest.mark.parametrize("copies", [1, 40])
def test_median_by_rank(spark, copies):
    rng = random.Random(3)
    data = []
    for _ in range(900):
        key = None if rng.random() < 0.1 else rng.choice("aaaabc")
        data.append((key, rng.choice([None, 1.5, rng.randrange(400) / copies]), float(rng.randrange(9))))
    data += [("d", None, 1.0), ("e", 2.0, None)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    found = rows(exact_median(df, ["k"], {"mx": "x", "my": "y"}))
    assert {key for key, _, _ in found} == {r[0] for r in data}
    for key, mx, my in found:
        for at_, got in ((1, mx), (2, my)):
            values = [r[at_] for r in data if r[0] == key and r[at_] is not None]
            assert got == (statistics.median(values) if values else None)


def test_median_of_one_group_for_all_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert rows(exact_median(df, [], {"m": "x"})) == [(50.0,)]


def test_median_of_large_values_intervals_and_whole_numbers(spark):
    df = spark.createDataFrame([(1, 1.7e308, 1), (1, 1.7e308, 2), (2, None, None), (3, 1e308, 5), (3, 1.7e308, 6)],
                               "k int, x double, n int")
    df = df.withColumn("t", F.make_dt_interval(secs=F.col("n")))
    found = exact_median(df, ["k"], {"mx": "x", "mn": "n", "mt": "t"})
    assert dict(found.dtypes)["mt"].startswith("interval")
    got = {r["k"]: (r["mx"], r["mn"], r["mt"] and r["mt"].total_seconds()) for r in found.collect()}
    assert got == {1: (1.7e308, 1.5, 1.5), 2: (None, None, None), 3: (1.35e308, 5.5, 5.5)}
    assert exact_median(df.limit(0), ["k"], {"mx": "x"}).count() == 0


def test_median_needs_no_job_before_the_action(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("median", "median")
    try:
        exact_median(df, ["k"], {"m": "x"})
        assert list(tracker.getJobIdsForGroup("median")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_approximate_median_has_the_same_shape(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    found = exact_median(df, ["k"], {"m": "x"}, approx=True)
    assert all(abs(r.m - 500) < 5 for r in found.collect())


@pytest.mark.parametrize("keys", [["subject_id"], ["subject_id", "day"], []])
def test_pulse_seconds_against_pairs(spark, keys):
    workouts = adapters.activities(spark, FOLDER).withColumn("day", F.to_date("dt"))
    # Half of the rows belong to one subject.
    hot = F.when(F.col("activity_id") % 2 == 0, F.lit(1)).otherwise(F.col("subject_id") % 7)
    workouts = workouts.withColumn("subject_id", hot)
    samples = adapters.pulse_samples(spark, FOLDER).withColumn("day", F.to_date("ts"))
    samples = samples.withColumn("subject_id", F.when(F.col("sample_id") % 2 == 0, F.lit(1)).otherwise(F.col("subject_id") % 7))
    plain = secs_in_pulse_zones(workouts, samples, keys=keys, plan="window")
    blocked = secs_in_pulse_zones(workouts, samples, keys=keys, plan="blocked", block_rows=150)
    assert rows(plain) == rows(blocked)
    hot_only = secs_in_pulse_zones(workouts, samples, keys=keys, max_group_rows=300)
    assert rows(hot_only) == rows(plain)

    # Pairs, in plain Python.
    acts = [r.asDict() for r in workouts.collect()]
    points = sorted((r.asDict() for r in samples.collect()), key=lambda r: (r["ts"], r["sample_id"]))
    previous, by_key = {}, {}
    for p in points:
        key = tuple(p[k] for k in keys)
        before = previous.get((key, p["day"]))
        previous[key, p["day"]] = p["ts"]
        if before is not None and p["hr"] is not None:
            by_key.setdefault(key, []).append((p["ts"], int((p["ts"] - before).total_seconds()), p["hr"], 220 - (p["ts"].year - p["birth_year"])))
    shares = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    expected = []
    for a in acts:
        key, secs = tuple(a[k] for k in keys), [0] * 6
        for ts, delta, hr, top in by_key.get(key, []):
            if 0 <= (ts - a["dt"]).total_seconds() < a["duration"]:
                for z in range(6):
                    if round(shares[z] * top) <= hr < round(shares[z + 1] * top):
                        secs[z] += delta
        expected.append((*key, a["activity_id"], *secs))
    assert rows(plain) == sorted(expected, key=repr)
    assert any(any(r[-6:]) for r in expected)


@pytest.mark.parametrize("plan", ["window", "blocked", "auto"])
def test_copies_of_samples_and_activities_change_nothing(spark, plan):
    workouts, samples = adapters.activities(spark, FOLDER), adapters.pulse_samples(spark, FOLDER)
    once = secs_in_pulse_zones(workouts, samples, keys=["subject_id"], plan="window")
    copied = samples.crossJoin(spark.range(3)).drop("id")
    twice = secs_in_pulse_zones(workouts.union(workouts), copied, keys=["subject_id"], plan=plan, max_group_rows=200)
    assert rows(twice) == rows(once)
