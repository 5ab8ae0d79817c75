"""Pulse-zone seconds of a stream against the batch operator, and the rule for late rows."""

import datetime as dt
import random

import pytest
from conftest import at, rows

from perioda.operators import secs_in_pulse_zones
from perioda.streaming import answered, pulse_time_line, stream_pulse_seconds
from perioda.streaming import pulse as streamed

ACTIVITY = "who string, activity_id long, dt timestamp_ntz, duration double"
SAMPLE = "who string, sample_id long, ts timestamp_ntz, hr long, birth_year long"


def run(spark, folder, delay):
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    line = pulse_time_line(read("activities", ACTIVITY), read("samples", SAMPLE), keys=["who"])
    query = stream_pulse_seconds(line, f"{folder}/out", f"{folder}/state", f"{folder}/check", keys=["who"], delay=delay)
    query.awaitTermination()
    return answered(spark, f"{folder}/out", line.schema, keys=["who"])


def arrive(make, folder, activities, samples):
    make(activities, ACTIVITY).coalesce(1).write.mode("append").parquet(f"{folder}/activities")
    make(samples, SAMPLE).coalesce(1).write.mode("append").parquet(f"{folder}/samples")


def sample(number, time, hr=150, who="a"):
    return who, number, at(time), hr, 1980


def test_pieces_add_up_and_late_rows_are_left_out(spark, make, tmp_path):
    folder = str(tmp_path)
    # Over midnight, without a duration, of no length, and without samples.
    long = ("a", 1, at("2024-01-05 23:00"), 7200.0)
    odd = [("a", 2, at("2024-01-05 10:00"), None), ("a", 3, at("2024-01-05 23:30"), 0.0), ("b", 4, at("2024-01-05 23:00"), 60.0), ("a", 5, None, 1.0)]
    arrive(make, folder, [long, *odd], [sample(1, "2024-01-05 23:10"), sample(2, "2024-01-05 23:10:30"), ("a", 9, None, 100, 1980)])
    assert rows(run(spark, folder, "30 minutes"), "activity_id", "secs_hr_zone0") == [(2, None), (5, None)]
    # The watermark goes to 23:40 and stands within the first activity.
    arrive(make, folder, [long, odd[0]], [sample(2, "2024-01-05 23:10:30"), sample(3, "2024-01-05 23:20"), sample(4, "2024-01-06 00:10")])
    assert rows(run(spark, folder, "30 minutes"), "activity_id") == [(2,), (3,), (4,), (5,)]
    # Late: a sample and an activity.  In time: the second of the new day counts from the first, the first nothing.
    late = [("a", 7, at("2024-01-05 23:05"), 60.0)]
    arrive(make, folder, late, [sample(5, "2024-01-05 23:15"), sample(6, "2024-01-06 00:11"), sample(7, "2024-01-06 09:00")])
    found = {row["activity_id"]: row for row in run(spark, folder, "30 minutes").collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    total = {k: sum(row[f"secs_hr_zone{z}"] or 0 for z in range(6)) for k, row in found.items()}
    # 30 s and 570 s before midnight, 60 s behind it.
    assert total == {1: 660, 2: 0, 3: 0, 4: 0, 5: 0} and found[3]["secs_hr_zone0"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_delay_gives_the_batch_result(spark, make, tmp_path, seed):
    pick = random.Random(seed)
    start = at("2024-01-01 00:00")
    moment = lambda: start + dt.timedelta(seconds=pick.randrange(5 * 86400), microseconds=pick.choice([0, 500_000]))
    samples = [(pick.choice("ab"), k, moment(), pick.choice([None, 90, 130, 150, 180]), 1980) for k in range(400)]
    activities = [(pick.choice("ab"), k, moment(), pick.choice([0.0, 900.5, 40_000.0, 200_000.0, -1.0, None])) for k in range(60)]
    arrival = lambda row: row[2] + dt.timedelta(hours=pick.uniform(0, 30))
    timed = [(arrival(row), name, row) for name, many in (("a", activities), ("s", samples)) for row in [*many, *many[::4]]]
    for k in range(5):
        part = [(n, row) for when, n, row in timed if min(4, (when - start) // dt.timedelta(hours=30)) == k]
        arrive(make, str(tmp_path), [row for n, row in part if n == "a"], [row for n, row in part if n == "s"])
    arrive(make, str(tmp_path), [], [sample(-1, "2025-01-01 00:00")])
    found = rows(run(spark, str(tmp_path), "61 hours"))
    assert found == rows(secs_in_pulse_zones(make(activities, ACTIVITY), make(samples, SAMPLE), keys=["who"]).select("who", "activity_id", *[f"secs_hr_zone{z}" for z in range(6)]))
    # The state is that of the last two batches, however many there were.
    assert len(streamed._batches(spark, f"{tmp_path}/state")) == 2


def test_a_batch_that_runs_again_changes_nothing(spark, make, tmp_path):
    folder = str(tmp_path)
    line = pulse_time_line(
        make([("a", 1, at("2024-01-05 10:00"), 600.0)], ACTIVITY),
        make([sample(1, "2024-01-05 10:01"), sample(2, "2024-01-05 10:02"), sample(3, "2024-01-05 10:05")], SAMPLE), keys=["who"],
    )
    later = pulse_time_line(make([], ACTIVITY), make([sample(4, "2024-01-05 10:08"), sample(5, "2024-01-06 10:08")], SAMPLE), keys=["who"])
    for number, batch in [(0, line), (0, line), (1, later), (1, later), (2, later.limit(0))]:
        streamed._close_piece(batch, number, f"{folder}/out", f"{folder}/state", ["who"], "2 minutes")
    found = answered(spark, f"{folder}/out", line.schema, keys=["who"]).collect()
    assert [sum(row[f"secs_hr_zone{z}"] for z in range(6)) for row in found] == [420]
