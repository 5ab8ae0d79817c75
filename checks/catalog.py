"""One query per operator and report, over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import adapters
from perioda import schemas
from perioda.functions import keep_range, period_of, recode, round_dp
from perioda.operators import (
    align_merge,
    backfill,
    daily_sketches,
    date_spine,
    diagonal_merge,
    merge_keep_existing,
    missing_days,
    null_profile,
    rank_error,
    secs_in_pulse_zones,
    sketched_quantiles,
)
from perioda.plans import activities as acts
from perioda.plans import bills, coverage, ingest, metrics, parts, strength
from perioda.session import file_system, new_shared_path, written_for_now
from perioda.sources import (
    day_activities,
    html_items,
    load_or_empty,
    merge_into_table,
    merge_version,
    parse_csv_sections,
    read_csv_sections,
    read_day_documents,
    read_gym_json,
    read_html_tables,
    read_metrics_xml,
    read_metrics_zip,
    read_open_activities,
    read_readable,
    read_table,
    read_version,
    remove_old_versions,
    replace_table,
    replace_version,
)
from perioda.sources.files import create_file
from perioda.sources.html import number
from perioda.sources.xml import EXPORT_MEMBER, KEPT_TYPES, TYPE_PREFIX, parse_archives
from perioda.streaming import (
    answered,
    daily_totals,
    pulse_time_line,
    stream_daily_totals,
    stream_into_table,
    stream_pulse_seconds,
    totals_by_period,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF_BILLS = dt.date(2001, 3, 15)
AS_OF = dt.date(2024, 2, 10)
ACTIVITY = "click"
SERIES = ["series_id"]
SUBJECT = ["subject_id"]
# Two batches that overlap, as an import of the last months does.
OLD_END, NEW_START = dt.date(2000, 1, 1), dt.date(1998, 1, 1)
OLD_DAYS_END, NEW_DAYS_START = dt.date(2024, 1, 20), dt.date(2024, 1, 10)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: round_dp(F.col(name), 6) for name in columns})


def _with_sets_text(df: DataFrame) -> DataFrame:
    text = {"rep_max": F.col("rep_max").cast("double"), "sets_text": F.array_join("sets", ",")}
    return df.withColumns(text).drop("sets")


def _normal(spark: SparkSession, folder: str, start: dt.date | None = None) -> DataFrame:
    return bills.normalize_bills(adapters.bills(spark, folder), start=start)


# --- bills -----------------------------------------------------------------


@query
def bill_total(spark, folder):
    return bills.bill_total(adapters.bills(spark, folder)).select("series_id", "bill_id", "dt", "total_cost")


@query
def dedup_bills(spark, folder):
    return bills.dedup_bills(adapters.bills(spark, folder).select("series_id", "dt", "bill_id"))


@query
def backfill_(spark, folder):
    columns = ["grid_amt", "heat_amt", "spot_price"]
    rows = adapters.bills(spark, folder).select("series_id", "bill_id", "dt", *columns)
    return backfill(rows, columns, series=SERIES, order="dt", tie="bill_id")


QUERIES["backfill"] = QUERIES.pop("backfill_")


@query
def normalize_bills(spark, folder):
    return _normal(spark, folder)


@query
def cost_by_period(spark, folder):
    return bills.cost_by_period(_normal(spark, folder), "month", by=SERIES)


@query
def consumption_by_period(spark, folder):
    return bills.consumption_by_period(_normal(spark, folder), "year", by=SERIES)


@query
def heat_price_by_period(spark, folder):
    return bills.heat_price_by_period(_normal(spark, folder), "quarter", by=SERIES)


@query
def unit_price_long(spark, folder):
    return bills.unit_price_long(_normal(spark, folder), "month", by=SERIES)


@query
def distinct_years(spark, folder):
    return bills.distinct_years(_normal(spark, folder))


YEARS = [1996, 1999, 2000]


def _year_compare(measure: str) -> Query:
    start = bills.first_day_of(YEARS)
    return lambda spark, folder: bills.year_compare(_normal(spark, folder, start), measure, YEARS, by=SERIES)


QUERIES["year_compare_cost"] = _year_compare("total_cost")
QUERIES["year_compare_kwh"] = _year_compare("usage_kwh")
QUERIES["year_compare_mwh"] = _year_compare("usage_mwh")


@query
def cost_share(spark, folder):
    return bills.cost_share(_normal(spark, folder, bills.first_day_shared(AS_OF_BILLS)), AS_OF_BILLS)


@query
def cost_by_period_range(spark, folder):
    start, end = dt.date(1996, 2, 10), dt.date(1998, 7, 31)
    return bills.cost_by_period(_normal(spark, folder), "quarter", by=SERIES, start=start, end=end)


@query
def from_invoices(spark, folder):
    """Bills under the headings of the invoice export, dates as text, read back."""
    headings = {new: old for old, new in schemas.INVOICE_COLUMNS.items() if new != "date"}
    raw = adapters.bills(spark, folder).withColumn("date", F.col("dt").cast("string")).drop("dt")
    return bills.from_invoices(raw.withColumnsRenamed(headings))


@query
def month_forecast(spark, folder):
    return bills.month_forecast(_normal(spark, folder), AS_OF_BILLS, by=SERIES)


@query
def null_profile_(spark, folder):
    return null_profile(adapters.bills(spark, folder))


QUERIES["null_profile"] = QUERIES.pop("null_profile_")


@query
def ingest_bills(spark, folder):
    rows = adapters.bills(spark, folder)
    existing = bills.normalize_bills(rows.filter(F.col("dt") < F.lit(OLD_END)))
    return bills.ingest_bills(existing, rows.filter(F.col("dt") >= F.lit(NEW_START)))


# --- activities ------------------------------------------------------------


@query
def activity_counts(spark, folder):
    return acts.activity_counts(adapters.activities(spark, folder))


@query
def activity_types(spark, folder):
    return acts.activity_types(adapters.activities(spark, folder))


@query
def distance_buckets(spark, folder):
    return acts.distance_buckets(adapters.activities(spark, folder), ACTIVITY, "week")


@query
def active_days_by_kind(spark, folder):
    gym = adapters.gym(spark, folder)
    return acts.active_days_by_kind(gym, adapters.activities(spark, folder), "month", activity=ACTIVITY)


def _walk_run(spark, folder, resum):
    samples, workouts = adapters.metrics(spark, folder), adapters.activities(spark, folder)
    return _round6(acts.walk_run_distance(samples, workouts, "week", activity=ACTIVITY, resum=resum), "value")


@query
def walk_run_distance(spark, folder):
    return _walk_run(spark, folder, True)


@query
def walk_run_distance_daily(spark, folder):
    return _walk_run(spark, folder, False)


@query
def distance_histogram(spark, folder):
    return acts.distance_histogram(adapters.activities(spark, folder), ACTIVITY)


@query
def pace_records(spark, folder):
    return acts.pace_records(adapters.activities(spark, folder), ACTIVITY)


@query
def longest_activities(spark, folder):
    return acts.longest_activities(adapters.activities(spark, folder))


@query
def longest_runs(spark, folder):
    runs = acts.longest_runs(adapters.activities(spark, folder), activity=ACTIVITY)
    seconds = F.col("duration").cast("interval second").cast("decimal(18,6)").cast("double")
    return runs.select("km", seconds.alias("duration_secs"), "day")


@query
def fastest_in_band(spark, folder):
    return acts.fastest_in_band(adapters.activities(spark, folder), activity=ACTIVITY)


@query
def pace_by_period(spark, folder):
    return _round6(acts.pace_by_period(adapters.activities(spark, folder), ACTIVITY, "week"), "median_mins_per_km")


@query
def pace_bounds(spark, folder):
    paces = acts.pace_by_period(adapters.activities(spark, folder), ACTIVITY, "week")
    return _round6(acts.pace_bounds(paces), "low", "high")


def _zone_medians(spark, folder):
    return acts.zone_medians(adapters.activities(spark, folder), ACTIVITY, "week")


@query
def zone_medians(spark, folder):
    return _round6(_zone_medians(spark, folder), *[f"median_zone{n}" for n in range(1, 6)])


@query
def zone_medians_long(spark, folder):
    return _round6(acts.zone_medians_long(_zone_medians(spark, folder)), "median_time")


@query
def zone_medians_sketched(spark, folder):
    """Weekly medians and upper quartiles from daily sketches, each judged by its true rank.

    Sketches draw lots, so the values differ between runs; that their ranks are near enough does not.
    """
    rows = adapters.activities(spark, folder).filter(F.col("activity") == ACTIVITY)
    values = ["secs_zone1", "distance"]
    parts = daily_sketches(rows, values)
    wanted = {"secs_mid": ("secs_zone1", 0.5), "distance_mid": ("distance", 0.5), "distance_high": ("distance", 0.75)}
    found = sketched_quantiles(parts, wanted, "week").withColumnRenamed("period", "of")
    held = rows.select(period_of("dt", "week").alias("period"), *values).join(found, F.col("period") == F.col("of"))

    def near(name, column, share):
        # Ties count half way, as any of their ranks would do.
        known = F.count(column)
        below, upto = F.count_if(F.col(column) < F.col(name)) / known, F.count_if(F.col(column) <= F.col(name)) / known
        return ((below <= share + 2 * rank_error()) & (upto >= share - 2 * rank_error())).alias(f"{name}_near")

    return held.groupBy("period").agg(F.count("*").alias("n"), *[near(n, c, s) for n, (c, s) in wanted.items()])


@query
def zone_bounds(spark, folder):
    samples = adapters.pulse_samples(spark, folder)
    return acts.zone_bounds(samples.select("birth_year", F.year("ts").cast("bigint").alias("year")))


def _with_odd_durations(workouts):
    """Some activities without a duration, and some that end before they start."""
    key = F.col("activity_id")
    odd = F.when(key % 83 == 0, F.lit(None)).when(key % 89 == 0, -F.col("duration")).otherwise(F.col("duration"))
    return workouts.withColumn("duration", odd)


def _by_day(spark, folder):
    workouts = _with_odd_durations(adapters.activities(spark, folder)).withColumn("day", F.to_date("dt"))
    return workouts, adapters.pulse_samples(spark, folder).withColumn("day", F.to_date("ts"))


@query
def hr_secs_in_zone(spark, folder):
    workouts, samples = _by_day(spark, folder)
    return secs_in_pulse_zones(workouts, samples, keys=["subject_id", "day"]).drop("day")


@query
def hr_secs_in_zone_past_midnight(spark, folder):
    return secs_in_pulse_zones(
        adapters.activities(spark, folder), adapters.pulse_samples(spark, folder), keys=SUBJECT
    )


def _zone_list():
    return F.array(
        *[
            F.struct(F.lit(n).cast("bigint").alias("zoneNumber"), F.col(name).alias("secsInZone"))
            for n, name in enumerate(schemas.ZONE_SECONDS, start=1)
        ]
    )


@query
def zone_enrich(spark, folder):
    workouts = adapters.activities(spark, folder)
    fetched = workouts.select("activity_id", F.from_json(F.to_json(_zone_list()), schemas.ZONE_LIST).alias("zones"))
    return ingest.zone_enrich(workouts.drop(*schemas.ZONE_SECONDS), fetched)


@query
def date_spine_(spark, folder):
    return date_spine(adapters.activities(spark, folder), AS_OF)


QUERIES["date_spine"] = QUERIES.pop("date_spine_")


@query
def missing_days_(spark, folder):
    return missing_days(adapters.activities(spark, folder), AS_OF, by=SUBJECT)


QUERIES["missing_days"] = QUERIES.pop("missing_days_")


@query
def period_slice(spark, folder):
    rows = adapters.activities(spark, folder).select("activity_id", "dt")
    # 2024-01-05 00:00:00 and 2024-01-20 12:30:00.250
    return strength.period_slice(rows, 1704412800000, 1705753800250)


@query
def date_range(spark, folder):
    rows = adapters.activities(spark, folder).select("activity_id", "dt")
    return keep_range(rows, dt.date(2024, 1, 5), dt.date(2024, 1, 20))


# --- metrics ---------------------------------------------------------------


@query
def bp_by_period_range(spark, folder):
    found = metrics.bp_by_period(
        adapters.metrics(spark, folder), "week", by=SUBJECT, start=dt.date(2024, 1, 4), end=dt.date(2024, 1, 20)
    )
    return _round6(found, "systolic", "diastolic")


@query
def bp_by_period(spark, folder):
    return _round6(metrics.bp_by_period(adapters.metrics(spark, folder), "week", by=SUBJECT), "systolic", "diastolic")


@query
def bp_extremes(spark, folder):
    return metrics.bp_extremes(metrics.bp_by_period(adapters.metrics(spark, folder), "day", by=SUBJECT), by=SUBJECT)


def _weight_fat(spark, folder, grain):
    return metrics.weight_fat_by_period(adapters.metrics(spark, folder), grain, by=SUBJECT)


@query
def weight_fat_by_period(spark, folder):
    return _round6(_weight_fat(spark, folder, "week"), "bodymass", "bodyfatpercentage")


@query
def weight_trend(spark, folder):
    return _round6(metrics.weight_trend(_weight_fat(spark, folder, "day"), by=SUBJECT), "bodymass", "weight")


@query
def fat_trend(spark, folder):
    return _round6(metrics.fat_trend(_weight_fat(spark, folder, "day"), by=SUBJECT), "bodyfatpercentage", "fat")


@query
def trend_bounds(spark, folder):
    trend = metrics.fat_trend(_weight_fat(spark, folder, "day"), by=SUBJECT)
    return _round6(metrics.trend_bounds(trend, "bodyfatpercentage", by=SUBJECT, scale=100.0), "low", "high")


# --- strength --------------------------------------------------------------


def _as_double(df):
    return df.withColumn("rep_max", F.col("rep_max").cast("double"))


@query
def gym_counts(spark, folder):
    return strength.gym_counts(adapters.gym(spark, folder))


@query
def gym_max_wide(spark, folder):
    columns = {
        "Barbell Bench Press": "bench_press",
        "Barbell Squat": "squat",
        "Barbell Deadlift": "deadlift",
        "Barbell Preacher Curl": "preacher_curl",
        "Other": "other",
    }
    wide = strength.gym_max_wide(adapters.gym(spark, folder), columns)
    return wide.select("month", *[F.col(c).cast("double").alias(c) for c in columns.values()])


@query
def gym_max_by_month(spark, folder):
    return _as_double(strength.gym_max_by_month(adapters.gym(spark, folder)))


@query
def gym_best(spark, folder):
    return _as_double(strength.gym_best(adapters.gym(spark, folder)))


@query
def gym_top5(spark, folder):
    return _with_sets_text(strength.gym_top(adapters.gym(spark, folder), tie=["row_id"]))


# --- coverage, functions, repairs ------------------------------------------


@query
def source_coverage(spark, folder):
    tables = {name: getattr(adapters, name)(spark, folder) for name in ("activities", "metrics", "gym")}
    return coverage.source_coverage(tables)


@query
def parse_dates(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = adapters.table(spark, folder, "events").select("event_id", text.alias("text"))
    at = F.to_timestamp_ntz("text", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.select(
        "event_id", at.alias("dt"), F.to_date(F.substring("text", 1, 10)).alias("day"),
        F.date_format(at, "yyyy-MM-dd").alias("iso_day"),
    )


def _legacy_text(spark, folder):
    """The legacy table as text, one column per heading."""
    rows = adapters.legacy_rows(spark, folder)
    return rows.select(
        "row_id", "form", F.col("minutes").cast("string").alias("minutes"), F.col("seconds").cast("string").alias("seconds"),
        (F.col("tenths") / 10).cast("string").alias("km"), F.format_number("kcal", 0).alias("kcal"),
        F.lit("Motionsslinga").alias("activity_name"), F.col("day").cast("string").alias("date"),
    )


@query
def recode_activity(spark, folder):
    return ingest.legacy_activities(_legacy_text(spark, folder))


@query
def quality_repair(spark, folder):
    rows = adapters.activities(spark, folder).select("activity_id", "dt", "distance", "duration")
    return ingest.quality_repair(rows)


@query
def ingest_legacy_activities(spark, folder):
    columns = ["activity_id", "subject_id", "dt", "activity", "distance", "duration"]
    existing = adapters.activities(spark, folder).select(*columns)
    return ingest.ingest_legacy_activities(existing, _legacy_text(spark, folder))


# --- merges ----------------------------------------------------------------


def _old(df, end=OLD_END):
    return df.filter(F.col("dt") < F.lit(end))


def _new(df, start=NEW_START):
    return df.filter(F.col("dt") >= F.lit(start))


@query
def merge_align(spark, folder):
    rows = adapters.activities(spark, folder)
    old = _old(rows, OLD_DAYS_END).select("activity_id", "dt", "activity", "distance", "duration")
    new = _new(rows, NEW_DAYS_START).select("activity_id", "dt", "distance", "secs_zone1", "secs_zone2")
    return align_merge(old, new)


@query
def merge_diagonal(spark, folder):
    rows = adapters.activities(spark, folder)
    day = F.to_date("dt").alias("day")
    old = _old(rows, OLD_DAYS_END).select("subject_id", day, "activity")
    new = _new(rows, NEW_DAYS_START).select("subject_id", day, (F.col("activity_id") % 7).cast("double").alias("duration"))
    return diagonal_merge(old, new)


@query
def merge_keep_existing_(spark, folder):
    gym = adapters.gym(spark, folder)
    old, new = _old(gym).withColumn("side", F.lit("old")), _new(gym).withColumn("side", F.lit("new"))
    kept = merge_keep_existing(old, new, ["dt", "exercise", "rep_max"], [F.col("row_id")])
    return _with_sets_text(kept).drop("row_id")


QUERIES["merge_keep_existing"] = QUERIES.pop("merge_keep_existing_")


# --- sources and sinks -----------------------------------------------------


def _put_files(spark, rows, label, ending):
    """A new folder with a file for each (name, content) of ``rows``, written by the tasks that have them.

    No folder of its own for a file: each would be listed, and put in its place, by itself.
    """
    path = new_shared_path(spark, label)
    files, place = file_system(spark, path)
    files.mkdirs(place)
    target = files.makeQualified(place).toString()

    def put(groups):
        import pandas as pd

        for table in groups:
            for name, content in zip(table["name"], table["content"]):
                with create_file(f"{target}/{name}{ending}") as file:
                    file.write(content)
            yield pd.DataFrame({"files": [len(table)]})

    # A file that is written twice, by a repeated task, is the same one.
    rows.mapInPandas(put, "files long").agg(F.sum("files")).first()
    return path


def _gym_json(spark, folder):
    raw = adapters.gym(spark, folder).select(
        F.col("dt").cast("string").alias("date"), F.col("exercise").alias("excercise"),
        F.col("rep_max").cast("string").alias("rep_max"), "sets",
    )
    path = new_shared_path(spark, "gym-json")
    raw.write.json(path)
    return path


@query
def src_json_gym(spark, folder):
    return _with_sets_text(read_gym_json(spark, _gym_json(spark, folder), multi_line=False))


ROWS_PER_ARRAY = 5000


@query
def src_json_gym_array(spark, folder):
    """The export's own form: files that hold one array of records each, over several lines."""
    raw = adapters.gym(spark, folder).select(
        F.to_json(
            F.struct(
                F.col("dt").cast("string").alias("date"), F.col("exercise").alias("excercise"),
                F.col("rep_max").cast("string").alias("rep_max"), "sets",
                # Not read: braces and quotes in a string of some records, objects in others.
                F.when(F.col("row_id") % 11 == 0, F.lit('a "}" b\\ {')).alias("note"),
                F.when(F.col("row_id") % 7 == 0, F.struct(F.struct(F.col("row_id")).alias("of"), F.lit("}").alias("mark"))).alias("more"),
            )
        ).alias("record"),
        F.floor(F.col("row_id") / ROWS_PER_ARRAY).alias("file"),
    )
    arrays = raw.groupBy("file").agg(F.array_join(F.collect_list("record"), ",\n").alias("records"))
    text = F.concat(F.lit("[\n"), "records", F.lit("\n]"))
    path = _put_files(spark, arrays.select(F.col("file").cast("string").alias("name"), text.cast("binary").alias("content")), "gym-arrays", ".json")
    return _with_sets_text(read_gym_json(spark, path, multi_line=True))


ROWS_PER_TEXT = 2000


def _gym_exports(spark, folder):
    """Export texts of at most ROWS_PER_TEXT logs each, by ranges of the unique row id."""
    # A column that is not read: a doubled quote in every row, and a cell of 100,000 characters in a few.
    # In some rows it goes on over one line end, in some over many.
    lines = F.when(F.col("row_id") % 7 == 0, F.lit("c,\n,""d""\n")).when(F.col("row_id") % 997 == 0, F.repeat(F.lit("more,\n"), 500))
    note = F.concat(F.lit('"a ""b"", '), F.coalesce(lines, F.lit("")), F.when(F.col("row_id") % 4999 == 0, F.repeat(F.lit("x"), 100_000)).otherwise(""), F.lit('"'))
    line = F.concat_ws(
        ",", note, F.col("dt").cast("string"), "exercise", F.col("rep_max").cast("string"),
        F.concat(F.lit('"'), F.array_join("sets", ","), F.lit('"')),
    )
    export = F.floor(F.col("row_id") / ROWS_PER_TEXT).alias("export")
    logs = adapters.gym(spark, folder).groupBy(export).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head = "### PROFILE\nname,height\nx,180\n\n### EXERCISE LOGS\n-----\nrow,mydate,ename,record,logs\n"
    text = F.concat(F.lit(head), F.array_join("lines", "\n"), F.lit("\n\n### NOTES\nrow,note\n1,none"))
    # Each of the three line ends in some of the texts.
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (F.col("export") % 3 + 1).cast("int"))
    return logs.select("export", F.replace(text, F.lit("\n"), end).alias("text"))


@query
def src_csv_section(spark, folder):
    return _with_sets_text(parse_csv_sections(_gym_exports(spark, folder), ["export"], "text")).drop("export")


@query
def src_csv_section_lines(spark, folder):
    exports = _gym_exports(spark, folder).select(F.col("export").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    path = _put_files(spark, exports, "gym-exports", ".csv")
    # Every file is taken for a large one, so all go through the line-by-line reader.
    return _with_sets_text(read_csv_sections(spark, path, max_text_bytes=0)).drop("source")


ROWS_PER_DAY_DOCUMENT = 50


def _day_documents_path(spark, folder, start=None, more=(), nulls="true"):
    """Day payloads as JSON lines: one document per subject, day and range of the unique activity id."""
    workouts, samples = adapters.activities(spark, folder), adapters.pulse_samples(spark, folder)
    if start:
        workouts, samples = _new(workouts, start), samples.filter(F.col("ts") >= F.lit(start))
    both = workouts.join(
        samples.select(F.col("sample_id").alias("activity_id"), "ts", "hr", "birth_year"), "activity_id"
    )
    activity = F.struct(
        F.col("activity_id").alias("activityId"),
        F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("startTimeLocal"),
        "distance",
        "duration",
        F.struct(F.col("activity").alias("typeKey")).alias("activityType"),
        _zone_list().alias("zones"),
        (F.col("activity_id") % 70).cast("int").alias("averageHR"),
        *more,
    )
    epoch_ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    sample = F.array(epoch_ms, F.col("hr").cast("bigint"))
    keys = ["subject_id", "birth_year", F.to_date("dt").alias("day")]
    part = F.floor(F.col("activity_id") / ROWS_PER_DAY_DOCUMENT).alias("part")
    days = both.groupBy(*keys, part).agg(
        F.collect_list(activity).alias("payload"), F.collect_list(sample).alias("heartRateValues")
    )
    document = F.struct(
        F.col("subject_id").alias("subjectId"),
        F.col("birth_year").alias("birthYear"),
        F.struct("payload").alias("ActivitiesForDay"),
        F.struct(F.struct("heartRateValues").alias("payload")).alias("AllDayHR"),
    )
    path = new_shared_path(spark, "day-documents")
    ignored = {"ignoreNullFields": "false" if nulls == "true" else "true"}
    days.select(F.to_json(document, ignored).alias("value")).write.text(path)
    return path


def _day_documents(spark, folder, start=None):
    return read_day_documents(spark, _day_documents_path(spark, folder, start), fields="averageHR int")


ACTIVITY_COLUMNS = ["activity_id", "subject_id", "dt", "activity", "distance", "duration"]


@query
def src_json_activities(spark, folder):
    found = day_activities(_day_documents(spark, folder))
    return found.select(*ACTIVITY_COLUMNS, *schemas.ZONE_SECONDS, F.col("averageHR").alias("average_hr"))


@query
def src_json_undeclared(spark, folder):
    """Nested fields that no schema names; one of them is in few documents, and nulls are left out."""
    id_ = F.col("activity_id")
    weather = F.struct(F.struct((id_ % 13 / 2).alias("speed")).alias("wind"), F.concat(F.lit("sky "), id_ % 3).alias("sky"))
    gear = F.when(id_ % 1000 < 3, F.struct(F.struct((id_ % 7).alias("number"), F.array(id_ % 5).alias("sizes")).alias("shoe")))
    path = _day_documents_path(spark, folder, more=[weather.alias("weather"), gear.alias("gear")], nulls="false")
    found = read_open_activities(spark, path)
    return found.select(
        *ACTIVITY_COLUMNS, F.col("`weather.wind.speed`").alias("wind"), F.col("`weather.sky`").alias("sky"),
        F.col("`gear.shoe.number`").alias("shoe"), F.get("`gear.shoe.sizes`", F.lit(0)).alias("size"),
    )


@query
def ingest_activities(spark, folder):
    existing = _old(adapters.activities(spark, folder), OLD_DAYS_END).select(*ACTIVITY_COLUMNS)
    merged = ingest.ingest_activities(existing, _day_documents(spark, folder, NEW_DAYS_START))
    return merged.select(*ACTIVITY_COLUMNS, "secs_zone1", "secs_zone5", *schemas.HEART_ZONE_SECONDS)


def _metric_records(spark, folder, *more):
    types = {name.lower(): TYPE_PREFIX + name for name in KEPT_TYPES}
    return adapters.timed_metrics(spark, folder).select(
        recode(F.col("metric"), types).alias("_type"), F.col("unit").alias("_unit"), F.col("value").alias("_value"), *more,
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100")).alias("_startDate"),
    )


def _metrics_xml(spark, folder):
    """All health samples as XML records, in files with a root element."""
    rows = _metric_records(spark, folder)
    path = new_shared_path(spark, "metrics-xml")
    rows.write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    return path


@query
def src_xml_metrics(spark, folder):
    return read_metrics_xml(spark, _metrics_xml(spark, folder)).drop("source")


ROWS_PER_ARCHIVE = 2000


def _packed_exports(spark, folder, members):
    """(source, content) of archives of all health samples, each member with a long tail behind its last record."""

    def packed(batches):
        import io
        import zipfile
        from itertools import groupby

        import pandas as pd

        # No more than an archive and a member's text is held, however many a task has.
        samples = (row for table in batches for row in zip(table["source"], table["part"], table["record"]))
        for source, of in groupby(samples, key=lambda row: row[0]):
            target = io.BytesIO()
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
                for number_, (_, own) in enumerate(groupby(of, key=lambda row: row[1])):
                    body = "\n".join(record for _, _, record in own)
                    text = f"<HealthData>\n{body}\n" + "<Workout a='<' />\n" * 50_000 + "</HealthData>"
                    archive.writestr(EXPORT_MEMBER.replace(".xml", f"{number_ or ''}.xml"), text)
                    archive.writestr(f"apple_health_export/other{number_}.txt", text)
            yield pd.DataFrame({"source": [source], "content": [target.getvalue()]})

    attributes = {"type": "_type", "unit": "_unit", "value": "_value", "startDate": "_startDate"}
    record = F.concat(
        F.lit("<Record"),
        *[F.concat(F.lit(f' {name}="'), F.col(column).cast("string"), F.lit('"')) for name, column in attributes.items()],
        F.lit("/>"),
    )
    rows = _metric_records(spark, folder, "row_id")
    # As many archives as the rows ask for.
    part = F.floor(F.col("row_id") / ROWS_PER_ARCHIVE)
    source = F.floor(part / members).cast("string").alias("source")
    # A record with a null in it is left out.
    rows = rows.select(source, part.cast("string").alias("part"), record.alias("record")).filter(F.col("record").isNotNull())
    return rows.repartition("source").sortWithinPartitions("source", "part").mapInPandas(packed, "source string, content binary")


@query
def src_xml_metrics_zip(spark, folder):
    """All health samples in zipped exports held in a table."""
    return parse_archives(_packed_exports(spark, folder, 1)).drop("source")


@query
def src_xml_metrics_zip_files(spark, folder):
    """The same from archive files with up to three exports each, which are unpacked one by one."""
    path = _put_files(spark, _packed_exports(spark, folder, 3).withColumnRenamed("source", "name"), "archives", ".zip")
    return read_metrics_zip(spark, path, member=EXPORT_MEMBER.replace(".xml", "*.xml")).drop("source")


@query
def ingest_metrics(spark, folder):
    existing = _old(adapters.metrics(spark, folder), OLD_DAYS_END).drop("subject_id")
    return ingest.ingest_metrics(existing, read_metrics_xml(spark, _metrics_xml(spark, folder)).drop("source"))


@query
def src_html_rows(spark, folder):
    return html_items(adapters.table(spark, folder, "pages"), ["page_id"], "html")


ROWS_PER_PAGE = 100


@query
def src_html_table(spark, folder):
    """Legacy rows laid out as tables on page files of at most ROWS_PER_PAGE rows, then read back.

    Every other page leaves out the closing tags, and writes umlauts as entities.
    Every third one has a first column that spans all its rows, and a note that spans two columns.
    """
    titles = ["Nr", *ingest.LEGACY_COLUMNS]
    spanned = F.col("page") % 3 == 0
    rows = _legacy_text(spark, folder)
    cells = ["row_id", *ingest.LEGACY_COLUMNS.values()]
    page = F.floor(F.col("row_id") / ROWS_PER_PAGE)
    loose = page % 2 == 1
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.when(loose, "\n").otherwise("</td>"))
    wide = F.when(page % 3 == 0, "<td class=note colspan='2'>x</td>").otherwise("")
    markup = F.concat(F.lit("<tr>"), cell(cells[0]), wide, *map(cell, cells[1:]), F.when(loose, "").otherwise("</tr>\n"))
    pages = rows.groupBy(page.alias("page")).agg(F.array_join(F.collect_list(markup), "").alias("body"), F.count("*").alias("n"))
    heading = "".join(f"<th>{title}</th>" for title in titles)
    first_row = F.concat(F.lit("<tr><td ROWSPAN="), F.col("n"), F.lit(">log"))
    pages = pages.withColumn("body", F.when(spanned, F.concat(first_row, F.substring("body", F.lit(5), F.length("body")))).otherwise(F.col("body")))
    notes = heading.replace("<th>Nr</th>", "<th>Log</th><th>Nr</th><th>Note</th><th>Note 2</th>")
    head = F.concat(F.lit("<tr>"), F.when(spanned, notes).otherwise(heading), F.lit("</tr>"))
    first = "<html><body><table><tr><td>meny</td></tr></table><table class='log'><tbody>"
    html = F.concat(F.lit(first), head, "body", F.lit("</tbody></table></body></html>"))
    escaped = html
    for letter, entity in (("ä", "&auml;"), ("å", "&#229;"), ("ö", "&#xF6;")):
        escaped = F.replace(escaped, F.lit(letter), F.lit(entity))
    text = F.when(F.col("page") % 2 == 1, escaped).otherwise(html)
    path = _put_files(spark, pages.select(F.col("page").cast("string").alias("name"), text.cast("binary").alias("content")), "pages", ".html")
    table = read_html_tables(spark, path, {"Nr": "row_id", **ingest.LEGACY_COLUMNS})
    return table.select(
        F.col("row_id").cast("bigint").alias("row_id"), "form", F.col("minutes").cast("bigint").alias("minutes"),
        F.col("seconds").cast("bigint").alias("seconds"), number(F.col("km")).alias("km"),
        number(F.col("kcal")).cast("bigint").alias("kcal"), F.col("date").cast("date").alias("day"),
    )


@query
def sink_roundtrip(spark, folder):
    path = new_shared_path(spark, "activities")
    rows = adapters.activities(spark, folder).select("activity_id", "subject_id", "dt", "activity", "distance")
    replace_table(rows, path)
    # Once more, from the table itself.
    replace_table(read_table(spark, path, rows.schema), path)
    return read_table(spark, path, rows.schema)


@query
def sink_merge_years(spark, folder):
    path = new_shared_path(spark, "gym")
    gym = adapters.gym(spark, folder).select(*schemas.GYM.fieldNames())
    for batch in (_old(gym), _new(gym)):
        merge_into_table(spark, path, batch, diagonal_merge, schemas.GYM)
    return _with_sets_text(read_table(spark, path, schemas.GYM))


@query
def sink_versions(spark, folder):
    """A reader that started before a merge keeps its version; the next one sees the merged one."""
    path = new_shared_path(spark, "gym-versions")
    rows = adapters.gym(spark, folder).drop("row_id")
    replace_version(_old(rows, OLD_END), path, column="dt")
    replace_version(read_version(spark, path, schemas.GYM), path, column="dt")
    before = read_version(spark, path, schemas.GYM)
    merge_version(spark, path, _new(rows, NEW_START), diagonal_merge, schemas.GYM)
    remove_old_versions(spark, path, keep=2, grace_seconds=0)
    after = read_version(spark, path, schemas.GYM)
    both = before.withColumn("version", F.lit(1)).unionByName(after.withColumn("version", F.lit(2)))
    return _with_sets_text(both)


@query
def src_bad_files(spark, folder):
    """All activities, though two of the folder's files are cut off; ``bad`` says how many were named."""
    path = new_shared_path(spark, "activities")
    rows = adapters.activities(spark, folder).select("activity_id", "subject_id", "dt", "activity", "distance")
    rows.write.parquet(path)
    for name in ("cut-1.parquet", "cut-2.parquet"):
        files, place = file_system(spark, f"{path}/{name}")
        stream = files.create(place, False)
        stream.write(bytearray(b"PAR1" + bytes(100)))
        stream.close()
    found, bad = read_readable(spark, path, rows.schema)
    return found.withColumn("bad", F.lit(bad.count()).cast("int"))


def _merged_in_three(spark, folder, seen=None):
    """Daily parts of the bills, brought up to date after each of three merges."""
    path, stored = new_shared_path(spark, "bills"), new_shared_path(spark, "bill-parts")
    normal = _normal(spark, folder)
    bounds = [None, OLD_END, dt.date(2001, 1, 1), None]
    series = T.StructType([normal.schema["series_id"]])
    with written_for_now(normal, "normal-bills") as once:
        for start, end in zip(bounds, bounds[1:]):
            batch = keep_range(once, start and start - dt.timedelta(days=90), end and end - dt.timedelta(days=1))
            merge_version(spark, path, batch, diagonal_merge, once.schema)
            years = parts.refresh_parts(spark, path, stored, once.schema, parts.BILL_MEASURES, by=SERIES)
            if seen is not None:
                seen.append(years)
    return parts.read_parts(spark, stored, series, parts.BILL_MEASURES)


@query
def cost_after_merges(spark, folder):
    return parts.cost_of_parts(_merged_in_three(spark, folder), "month", by=SERIES)


@query
def coverage_after_merges(spark, folder):
    return parts.coverage_of_parts("bills", _merged_in_three(spark, folder))


@query
def load_or_empty_(spark, folder):
    """A table that is there stacked on one that is not."""
    path = new_shared_path(spark, "gym")
    adapters.gym(spark, folder).select(*schemas.GYM.fieldNames()).write.parquet(path)
    present = load_or_empty(spark, path, schemas.GYM)
    return _with_sets_text(present.unionByName(load_or_empty(spark, f"{path}-missing", schemas.GYM)))


QUERIES["load_or_empty"] = QUERIES.pop("load_or_empty_")


@query
def ingest_gym_json(spark, folder):
    existing = _old(adapters.gym(spark, folder)).select(*schemas.GYM.fieldNames())
    history = read_gym_json(spark, _gym_json(spark, folder), multi_line=False)
    return _with_sets_text(ingest.ingest_gym_json(existing, history))


@query
def ingest_gym_csv(spark, folder):
    existing = _old(adapters.gym(spark, folder)).select(*schemas.GYM.fieldNames())
    logs = parse_csv_sections(_gym_exports(spark, folder), ["export"], "text").drop("export")
    return _with_sets_text(ingest.ingest_gym_csv(existing, _new(logs)))


@query
def stream_ingest(spark, folder):
    """Two overlapping batches of samples arrive as files and are merged one after the other."""
    arrivals, path = new_shared_path(spark, "arrivals"), new_shared_path(spark, "metrics")
    samples = adapters.metrics(spark, folder)
    for number_, batch in enumerate((_old(samples, OLD_DAYS_END), _new(samples, NEW_DAYS_START))):
        batch.write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schemas.METRICS).parquet(arrivals)
        stream_into_table(stream, path, align_merge, schemas.METRICS, f"{path}-checkpoint").awaitTermination()
    return read_table(spark, path, schemas.METRICS)


@query
def stream_totals(spark, folder):
    """Weekly totals of samples that arrive in five files, in no order of time, a third of them twice."""
    path, out = new_shared_path(spark, "sample-arrivals"), new_shared_path(spark, "sample-days")
    rows = adapters.timed_metrics(spark, folder).select("row_id", "subject_id", "ts", "value")
    part = F.pmod(F.xxhash64("row_id"), F.lit(5))
    for number in range(5):
        again = F.pmod(F.xxhash64(F.lit(1), "row_id"), F.lit(3)) == 0
        chosen = (part == number) | ((part == (number + 1) % 5) & again)
        rows.filter(chosen).coalesce(1).write.mode("append").parquet(path)
    # What comes a year later closes all days before it; its own stays open.
    later = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("row_id"), F.lit(-1).cast("bigint").alias("subject_id"),
        (F.col("ts") + F.expr("interval 365 days")).alias("ts"), F.lit(0.0).alias("value"),
    )
    later.write.mode("append").parquet(path)
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    totals = daily_totals(arrivals, ["value"], ids=["row_id"], by=["subject_id"], column="ts", delay="90 days")
    stream_daily_totals(totals, out, new_shared_path(spark, "totals-checkpoint")).awaitTermination()
    return totals_by_period(spark, out, totals.schema, ["value"], "week", by=["subject_id"])


@query
def stream_hr_secs(spark, folder):
    """Pulse-zone seconds with samples and activities in five arrivals by time, which overlap by four days."""
    workouts, samples = _by_day(spark, folder)
    places = {name: new_shared_path(spark, f"{name}-arrivals") for name in ("workouts", "samples")}
    first, last = samples.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    start, end = (F.to_timestamp_ntz(F.lit(text)) for text in (first, last))

    def arrival_of(time):
        share = F.timestamp_diff("MICROSECOND", start, time) / (F.timestamp_diff("MICROSECOND", start, end) + 1)
        return F.least(F.floor(5 * share), F.lit(4))

    def arrive(rows, column, row_id, number_, name):
        # Rows of an arrival's last four days come with it, with the next one, or with both.
        own, late = arrival_of(F.col(column)), arrival_of(F.col(column) + F.expr("interval 4 days"))
        turn = F.pmod(F.xxhash64(row_id), F.lit(3))
        chosen = F.when(turn == 0, late == number_).when(turn == 1, own == number_).otherwise((own == number_) | (late == number_))
        rows.filter(chosen).write.mode("append").parquet(places[name])

    keys = ["subject_id", "day"]
    path, state, check = (new_shared_path(spark, f"pulse-{name}") for name in ("answers", "state", "checkpoint"))
    read = lambda name, rows: spark.readStream.schema(rows.schema).parquet(places[name])
    # Each arrival is a batch, of as many files as tasks wrote; the sixth one comes a year later and closes all activities.
    for number_ in range(6):
        if number_ < 5:
            arrive(workouts, "dt", "activity_id", number_, "workouts")
            arrive(samples, "ts", "sample_id", number_, "samples")
        else:
            beyond = samples.limit(1).withColumn("ts", end + F.expr("interval 365 days")).withColumn("day", F.to_date("ts"))
            beyond.write.mode("append").parquet(places["samples"])
        line = pulse_time_line(read("workouts", workouts), read("samples", samples), keys=keys)
        stream_pulse_seconds(line, path, state, check, keys=keys, delay="5 days").awaitTermination()
    return answered(spark, path, line.schema, keys=keys).drop("day")
