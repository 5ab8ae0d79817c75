"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.  Every query runs
once to warm up and then BENCH_RUNS times over whole tables, its rows going to
a sink that drops them; the median of those runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from perioda import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = (
    "cost_by_period", "unit_price_long", "year_compare_cost", "cost_share", "month_forecast", "backfill",
    "dedup_bills", "ingest_bills", "activity_counts", "distance_buckets", "active_days_by_kind", "walk_run_distance",
    "distance_histogram", "pace_records", "longest_activities", "longest_runs", "fastest_in_band", "pace_by_period",
    "zone_medians", "hr_secs_in_zone", "zone_enrich", "missing_days", "bp_by_period", "bp_extremes", "weight_trend",
    "fat_trend", "gym_counts", "gym_max_wide", "gym_max_by_month", "gym_top5", "source_coverage", "quality_repair",
    "merge_align", "merge_diagonal", "merge_keep_existing", "src_csv_section", "src_json_activities",
    "src_xml_metrics", "src_html_rows", "sink_roundtrip",
)


def seconds(spark, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINES
    times, shuffle = {}, {}
    for name in names:
        before = shuffled(spark)
        seconds(spark, name)
        shuffle[name] = shuffled(spark) - before
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
        print(f"{name:28s} {times[name]:.3f} s {shuffle[name] / 1e6:9.2f} MB shuffled", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    line = {"metric": "headline_queries_wall_time", "value": total, "unit": "sec", "queries": times,
            "shuffle_bytes": shuffle, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
