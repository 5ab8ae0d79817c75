"""Physical plans: what must and must not be in them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import adapters
from checks.catalog import QUERIES
from perioda.functions import keep_periods, keep_range
from perioda.operators import backfill
from perioda.plans import bills, strength

FOLDER = "/root/testdata/sf0.001"
# These write and read files, or stream, while they are built.
WRITING = {
    "src_json_gym", "src_csv_section_lines", "src_json_activities", "src_xml_metrics", "sink_roundtrip",
    "sink_merge_years", "load_or_empty", "ingest_gym_json", "ingest_activities", "ingest_metrics", "stream_ingest",
    "src_json_gym_array", "src_xml_metrics_zip", "src_xml_metrics_zip_files", "src_html_table",
}
# Ends in a handful of rows: one total over all groups, or a sort of them.
ONE_ROW = {"cost_share", "null_profile", "pace_bounds", "source_coverage", "bp_extremes", "longest_runs",
           "fastest_in_band", "date_spine", "coverage_after_merges"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_pairs_no_python_no_single_task(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Pandas", "InArrow"):
        assert bad not in plan
    if name not in ONE_ROW:
        assert "SinglePartition" not in plan


def test_range_and_columns_reach_the_scan(spark):
    df = adapters.activities(spark, FOLDER)
    plan = plan_of(keep_range(df, dt.date(2024, 1, 5), dt.date(2024, 1, 9)).select("activity_id"))
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "LessThanOrEqual(ts,2024-01-09" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_period_range_reaches_the_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet").withColumnRenamed("o_orderdate", "dt")
    plan = plan_of(keep_periods(df, dt.date(1997, 1, 15), dt.date(1997, 6, 3), "month"))
    assert "1997-02-01" in plan and "1997-07-01" in plan and "PushedFilters: [IsNotNull(o_orderdate), GreaterThan" in plan


def test_year_comparison_filters_dates_before_the_points(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    df = df.select(F.col("o_orderdate").alias("dt"), F.col("o_totalprice").alias("total_cost"))
    assert "PushedFilters: [Or(" in plan_of(bills.year_compare(df, "total_cost", [1996, 1999]))


def test_the_first_day_reaches_the_scan_below_the_fill(spark):
    for name in ("year_compare_cost", "cost_share"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        day_ = "1996-01-01" if name == "year_compare_cost" else "2000-01-01"
        scans = [line for line in plan.split("\n") if "PushedFilters" in line and "orders" in line]
        assert scans and all(f"GreaterThanOrEqual(o_orderdate,{day_}" in line for line in scans), scans


def test_imported_days_are_parsed_once(spark):
    plan = plan_of(QUERIES["ingest_activities"](spark, FOLDER))
    assert plan.count("FileScan json") <= 1


def test_normalised_bills_shrink_before_the_shuffle(spark):
    plan = plan_of(bills.normalize_bills(adapters.bills(spark, FOLDER)))
    assert "partial_min_by" in plan and "SortAggregate" not in plan
    # Reports per series reuse the partitioning of the fill.
    both = plan_of(bills.cost_by_period(bills.normalize_bills(adapters.bills(spark, FOLDER)), "month", by=["series_id"]))
    assert both.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning")


def test_top_rows_are_cut_before_the_shuffle(spark):
    assert plan_of(strength.gym_top(adapters.gym(spark, FOLDER))).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(QUERIES["longest_runs"](spark, FOLDER))
    assert plan_of(bills.dedup_bills(adapters.bills(spark, FOLDER))).count("WindowGroupLimit") == 2


def test_fill_reads_backwards(spark):
    rows = adapters.bills(spark, FOLDER)
    plan = plan_of(backfill(rows, ["grid_amt"], series=["series_id"], order="dt", tie="bill_id"))
    assert "unboundedpreceding$(), currentrow$()" in plan and "unboundedfollowing" not in plan


def test_merge_reads_only_the_partitions_of_the_batch(spark, tmp_path):
    from perioda.operators import diagonal_merge
    from perioda.schemas import GYM
    from perioda.sources import merge_into_table, tables

    path, seen = str(tmp_path / "gym"), []
    gym = adapters.gym(spark, FOLDER).select(*GYM.fieldNames())
    merge_into_table(spark, path, gym, diagonal_merge, GYM)

    def merge(existing, batch):
        seen.append(plan_of(existing))
        return diagonal_merge(existing, batch)

    merge_into_table(spark, path, gym.filter("year(dt) = 1999"), merge, GYM)
    assert "PartitionFilters: [isnotnull(year" in seen[0] and "= 1999)]" in seen[0]
    assert tables.read_table(spark, path, GYM).count() == gym.distinct().count()
