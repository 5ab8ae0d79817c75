"""The library's four tables, derived from the driver's TPC-H-like tables.

Amounts are integers or binary fractions, so sums do not depend on the order
in which they are added.  Nulls are put in by key, since the tables have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What stands for what.
METRIC_OF_EVENT = {
    "click": "bodymass",
    "view": "bodyfatpercentage",
    "error": "bloodpressuresystolic",
    "signup": "bloodpressurediastolic",
}
OTHER_METRIC = "distancewalkingrunning"
UNIT_OF_METRIC = {
    "bodymass": "kg",
    "bodyfatpercentage": "%",
    "bloodpressuresystolic": "mmHg",
    "bloodpressurediastolic": "mmHg",
    "distancewalkingrunning": "km",
}
EXERCISE_OF_PRIORITY = {
    "1-URGENT": "Barbell Bench Press",
    "2-HIGH": "Barbell Squat",
    "3-MEDIUM": "Barbell Deadlift",
    "5-LOW": "Barbell Preacher Curl",
}


# Declared, so that no job has to look into the files first.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "pages": "page_id bigint, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _choose(column: str, labels: dict[str, str], other: str) -> Column:
    chosen = F
    for key, label in labels.items():
        chosen = chosen.when(F.col(column) == key, F.lit(label))
    return chosen.otherwise(F.lit(other))


def bills(spark: SparkSession, folder: str) -> DataFrame:
    per_order = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *[
            F.expr(f"cast(sum(cast(round({column} * 100) as bigint)) as double) as {name}")
            for name, column in (("grid", "l_extendedprice"), ("trade", "l_tax"), ("heat", "l_discount"))
        ],
        F.expr("sum(l_quantity) as qty"),
    )
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as id", "o_custkey", "cast(o_orderdate as date) as dt")
    return orders.join(per_order, F.col("l_orderkey") == F.col("id"), "left").selectExpr(
        "o_custkey % 50 as series_id",
        "id as bill_id",
        "dt",
        "if(id % 7 = 0, null, grid) as grid_amt",
        "trade as trade_amt",
        "if(id % 11 = 0, null, heat) as heat_amt",
        "cast(id % 140 as double) as service_fee",
        "qty as usage_kwh",
        "qty / 64 as usage_mwh",
        "if(id % 5 = 0, null, cast(id % 90 as double) / 4) as spot_price",
        "cast(id % 37 as double) / 8 as tax_price",
        "cast(id % 41 as double) / 8 as transfer_price",
        "cast(id % 29 as double) / 16 as variable_price",
        "cast(id % 23 as double) / 16 as markup_price",
        "cast(id % 800 as double) / 2 as heat_price",
    )


def activities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as activity_id",
        "user_id as subject_id",
        "ts as dt",
        "event_type as activity",
        "if(event_id % 97 = 0, null, value * 100) as distance",
        "cast(event_id * 37 % 5400 + 300 as double) as duration",
        *[f"cast(event_id * {13 * n} % 900 as double) as secs_zone{n}" for n in range(1, 6)],
    )


def timed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics with the time of each sample and its unit."""
    value = """case event_type when 'click' then cast(60 + event_id % 40 as double)
        when 'view' then cast(event_id % 32 as double) / 64
        when 'error' then cast(100 + event_id % 60 as double)
        when 'signup' then cast(60 + event_id % 40 as double)
        else cast(event_id % 50 as double) / 8 end"""
    units = {event: UNIT_OF_METRIC[metric] for event, metric in METRIC_OF_EVENT.items()}
    return table(spark, folder, "events").select(
        F.expr("user_id % 5 as subject_id"),
        F.col("event_id").alias("row_id"),
        "ts",
        _choose("event_type", METRIC_OF_EVENT, OTHER_METRIC).alias("metric"),
        _choose("event_type", units, UNIT_OF_METRIC[OTHER_METRIC]).alias("unit"),
        F.expr(value).alias("value"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return timed_metrics(spark, folder).select("subject_id", F.to_date("ts").alias("dt"), "metric", "unit", "value")


def gym(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    sets = F.expr("concat(o_orderkey % 100, 'x12,', o_orderkey % 50, 'x10')")
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("dt"),
        _choose("o_orderpriority", EXERCISE_OF_PRIORITY, "Other").alias("exercise"),
        F.expr("cast(cast(o_orderkey % 400 as double) / 4 as float) as rep_max"),
        F.split(sets, ",").alias("sets"),
        key.alias("row_id"),
    )


def pulse_samples(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.when(F.col("event_id") % 11 != 0, 60 + F.col("event_id") % 150)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("sample_id"),
        "ts",
        rate.alias("hr"),
        (1950 + F.col("user_id") % 50).alias("birth_year"),
    )


def legacy_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as the legacy export shows them, one per order."""
    form = _choose("o_orderpriority", {"1-URGENT": "Löpning", "2-HIGH": "Promenad"}, "Simning")
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("row_id"),
        form.alias("form"),
        (key % 90).alias("minutes"),
        (key % 60).alias("seconds"),
        (key % 250).alias("tenths"),
        (key % 1500).alias("kcal"),
        # Moved on by 13 years, across the end of the legacy export.
        F.add_months(F.to_date("o_orderdate"), 13 * 12).alias("day"),
    )
