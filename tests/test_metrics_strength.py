"""Health samples and strength training: hand-computed values."""

from conftest import day, rows

from perioda.plans import metrics, strength


def weights(make, values):
    return make(
        [(1, day(f"2024-0{i + 1}-01"), v, f) for i, (v, f) in enumerate(values)],
        "subject_id int, period date, bodymass double, bodyfatpercentage double",
    )


def test_weight_trend(make):
    df = weights(make, [(69.0, None), (71.0, 0.25), (72.0, 0.25), (76.0, 0.5), (74.0, 0.25)])
    trend = metrics.weight_trend(df, by=["subject_id"])
    assert [r[1] for r in rows(trend, "period", "weight")] == [73.5, 73.0, 74.0, 73.5]


def test_fat_trend_needs_three_values(make):
    df = weights(make, [(80.0, 0.125), (80.0, None), (80.0, 0.25), (80.0, 0.25), (80.0, 0.25)])
    trend = metrics.fat_trend(df, by=["subject_id"])
    assert [r[1] for r in rows(trend, "period", "fat")] == [25.0, 25.0, 25.0, 25.0, 25.0]
    assert rows(metrics.trend_bounds(trend, "bodyfatpercentage", scale=100.0)) == [(12.5, 25.0)]


def test_pressure_is_a_mean_of_daily_means(make):
    df = make(
        [(day("2024-01-01"), "bloodpressuresystolic", 120.0), (day("2024-01-01"), "bloodpressuresystolic", 130.0),
         (day("2024-01-02"), "bloodpressuresystolic", 145.0), (day("2024-01-02"), "stepcount", 9.0)],
        "dt date, metric string, value double",
    )
    pressure = metrics.bp_by_period(df, "month")
    assert rows(pressure) == [(day("2024-01-01"), 135.0, None)]
    assert metrics.bp_extremes(pressure).count() == 0


def test_pressure_extremes(make):
    df = make([(day(f"2024-01-0{i}"), 120.0 + i, 80.04 + i) for i in range(1, 8)], "period date, systolic double, diastolic double")
    found = metrics.bp_extremes(df)
    assert rows(found, "kind", "diastolic")[:5] == [("highest", 83.0 + i) for i in range(5)]
    assert rows(found, "kind", "diastolic")[5:] == [("lowest", 81.0 + i) for i in range(5)]


def gym(make, items):
    return make([(day(d), e, r, ["60x12"]) for d, e, r in items], "dt date, exercise string, rep_max float, sets array<string>")


def test_gym_top_drops_unknown_weights(make):
    squat = "Barbell Squat"
    df = gym(make, [("2024-01-01", squat, w) for w in (10.0, 60.0, None, 40.0, 30.0, 20.0, 50.0)])
    assert [r.rep_max for r in strength.gym_top(df).orderBy("rep_max").collect()] == [20.0, 30.0, 40.0, 50.0, 60.0]


def test_gym_best(make):
    press = "Barbell Bench Press"
    df = gym(make, [("2024-01-05", press, 80.0), ("2024-01-20", press, 85.0), ("2024-02-01", press, 70.0), ("2024-02-01", "Plank", 1.0)])
    assert rows(strength.gym_max_by_month(df)) == [(day("2024-01-01"), press, 85.0), (day("2024-02-01"), press, 70.0)]
    assert rows(strength.gym_best(df)) == [(press, 85.0)]
    assert [tuple(r) for r in strength.gym_counts(df).collect()] == [(press, 3), ("Plank", 1)]
    wide = strength.gym_max_wide(df, {press: "press", "Barbell Squat": "squat"})
    assert rows(wide) == [(day("2024-01-01"), 85.0, None), (day("2024-02-01"), 70.0, None)]
