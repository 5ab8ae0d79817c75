"""Closed days of a stream against a batch, and the rule for late rows."""

import datetime as dt

from conftest import at, day, rows

from perioda.streaming import daily_totals, stream_daily_totals, totals_by_period

SCHEMA = "id long, who string, ts timestamp_ntz, v double"


def run(spark, folder, delay="2 days"):
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    totals = daily_totals(arrivals, ["v"], ids=["id"], by=["who"], column="ts", delay=delay)
    stream_daily_totals(totals, f"{folder}/out", f"{folder}/check").awaitTermination()
    return totals_by_period(spark, f"{folder}/out", totals.schema, ["v"], "day", by=["who"])


def arrive(make, folder, *batch):
    make(list(batch), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_days_close_once_and_late_rows_are_left_out(spark, make, tmp_path):
    folder = str(tmp_path)
    arrive(make, folder, (1, "a", at("2024-01-05 10:00"), 1.0), (2, "a", at("2024-01-04 23:59"), 2.0), (3, "b", None, 9.0))
    arrive(make, folder, (1, "a", at("2024-01-05 10:00"), 1.0), (4, "b", at("2024-01-05 01:00"), 4.0))
    assert run(spark, folder).count() == 0
    # Two days behind this one, the fourth and the fifth are closed.
    arrive(make, folder, (5, "a", at("2024-01-08 12:00"), 5.0))
    first = [("a", day("2024-01-04"), 1, 2.0), ("a", day("2024-01-05"), 1, 1.0), ("b", day("2024-01-05"), 1, 4.0)]
    assert rows(run(spark, folder)) == first
    # Late by the rule, a repetition, and in time.
    arrive(make, folder, (6, "a", at("2024-01-04 12:00"), 100.0), (5, "a", at("2024-01-08 12:00"), 5.0), (7, "a", at("2024-01-07 12:00"), 7.0))
    arrive(make, folder, (8, "a", at("2024-03-01 00:00"), 0.0))
    assert rows(run(spark, folder)) == sorted([*first, ("a", day("2024-01-07"), 1, 7.0), ("a", day("2024-01-08"), 1, 5.0)], key=repr)
    assert run(spark, folder).count() == 5


def test_any_order_gives_the_batch_result(spark, make, tmp_path):
    values = [(k, "ab"[k % 2], at("2024-01-01 00:00") + dt.timedelta(hours=7 * (k * 37 % 100)), float(k)) for k in range(100)]
    for part in range(4):
        arrive(make, str(tmp_path), *values[part::4], *values[part + 1 :: 8])
    arrive(make, str(tmp_path), (-1, "z", at("2025-01-01 00:00"), 0.0))
    expected = {}
    for _, who, ts, v in values:
        n, total = expected.get((who, ts.date()), (0, 0.0))
        expected[who, ts.date()] = (n + 1, total + v)
    assert rows(run(spark, str(tmp_path), "60 days")) == sorted([(*k, *v) for k, v in expected.items()], key=repr)
