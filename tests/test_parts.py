"""Stored daily parts: equal to reports over all rows, made anew for touched years only, whatever breaks off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from perioda.operators import diagonal_merge
from perioda.plans import bills, coverage, parts
from perioda.sources import merge_version, read_version, replace_version, versions
from conftest import rows

SCHEMA = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("dt", T.DateType())])
for _name in parts.BILL_MEASURES:
    SCHEMA = SCHEMA.add(_name, T.DoubleType())
BY = T.StructType([SCHEMA["series_id"]])


def bill_rows(spark, days):
    made = [F.expr(f"IF(id % 7 = {k % 7}, NULL, CAST(id * {k + 1} % 64 AS double) / 4)").alias(m) for k, m in enumerate(parts.BILL_MEASURES)]
    start, end = days
    day = F.expr("date_add(DATE '2020-01-01', CAST(id % 1500 AS int))").alias("dt")
    return spark.range(start, end).select((F.col("id") % 3).alias("series_id"), day, *made)


def refreshed(spark, path):
    return parts.refresh_parts(spark, f"{path}/t", f"{path}/p", SCHEMA, parts.BILL_MEASURES, by=["series_id"])


def stored(spark, path):
    return parts.read_parts(spark, f"{path}/p", BY, parts.BILL_MEASURES)


def test_equal_to_full_runs_and_only_touched_years(spark, tmp_path):
    path = str(tmp_path)
    for days, expected in [((0, 400), [2020, 2021]), ((350, 800), [2020, 2021, 2022]), ((1100, 1200), [2023]), ((1100, 1150), [2023])]:
        merge_version(spark, f"{path}/t", bill_rows(spark, days), diagonal_merge, SCHEMA)
        assert refreshed(spark, path) == expected
        assert refreshed(spark, path) == []
        full, own = read_version(spark, f"{path}/t", SCHEMA), stored(spark, path)
        for grain in ("none", "week", "month", "year"):
            assert rows(parts.cost_of_parts(own, grain, by=["series_id"])) == rows(bills.cost_by_period(full, grain, by=["series_id"]))
        assert rows(parts.coverage_of_parts("b", own)) == rows(coverage.source_coverage({"b": full}))
    first, last = dt.date(2020, 2, 10), dt.date(2021, 3, 3)
    ours = parts.cost_of_parts(own, "quarter", start=first, end=last)
    assert rows(ours) == rows(bills.cost_by_period(full, "quarter", start=first, end=last))
    month = parts.bounds_of_parts(own, "month", ["spot_price"])
    plain = full.groupBy(F.trunc("dt", "month").alias("period")).agg(
        F.count("*"), F.avg("spot_price"), F.min("spot_price"), F.max("spot_price"))
    assert rows(month) == rows(plain)


def test_touched_years_alone_are_read(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path), []
    merge_version(spark, f"{path}/t", bill_rows(spark, (0, 1400)), diagonal_merge, SCHEMA)
    refreshed(spark, path)
    merge_version(spark, f"{path}/t", bill_rows(spark, (800, 900)), diagonal_merge, SCHEMA)
    plain = parts.daily_parts
    monkeypatch.setattr(parts, "daily_parts", lambda rows, *a, **k: (read.extend(rows.inputFiles()), plain(rows, *a, **k))[1])
    assert refreshed(spark, path) == [2022]
    assert read and all("/year=2022/" in file for file in read)


def test_years_that_went_go_from_the_parts(spark, tmp_path):
    path = str(tmp_path)
    replace_version(bill_rows(spark, (0, 800)), f"{path}/t", column="dt")
    refreshed(spark, path)
    replace_version(bill_rows(spark, (0, 300)), f"{path}/t", column="dt")
    assert refreshed(spark, path) == [2020]
    assert stored(spark, path).agg(F.sum("rows")).first()[0] == 300


@pytest.mark.parametrize("step", ["_put", "_publish"])
def test_a_run_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    merge_version(spark, f"{path}/t", bill_rows(spark, (0, 300)), diagonal_merge, SCHEMA)
    refreshed(spark, path)
    merge_version(spark, f"{path}/t", bill_rows(spark, (200, 500)), diagonal_merge, SCHEMA)
    before = rows(stored(spark, path).select("series_id", "dt", "rows"))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, step, fail)
        with pytest.raises(OSError):
            refreshed(spark, path)
    assert rows(stored(spark, path).select("series_id", "dt", "rows")) == before
    assert refreshed(spark, path) == [2020, 2021]
    assert stored(spark, path).agg(F.sum("rows")).first()[0] == 500


def test_no_rows_and_no_dates(spark, make, tmp_path):
    path = str(tmp_path)
    assert refreshed(spark, path) == [] and stored(spark, path).count() == 0
    assert parts.coverage_of_parts("b", stored(spark, path)).first()["rows"] == 0
    undated = bill_rows(spark, (0, 3)).withColumn("dt", F.lit(None).cast("date"))
    merge_version(spark, f"{path}/t", undated, diagonal_merge, SCHEMA)
    assert refreshed(spark, path) == [0] and refreshed(spark, path) == []
    assert {r["dt"] for r in stored(spark, path).collect()} == {None}
    merge_version(spark, f"{path}/t", bill_rows(spark, (0, 3)), diagonal_merge, SCHEMA)
    assert refreshed(spark, path) == [2020]


def test_tables_without_years_are_refused(spark, tmp_path):
    replace_version(bill_rows(spark, (0, 3)), f"{tmp_path}/t")
    with pytest.raises(ValueError):
        refreshed(spark, str(tmp_path))
