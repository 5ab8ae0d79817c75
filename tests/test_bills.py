"""Bills: hand-computed values."""

import datetime as dt
import math

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from perioda.operators import backfill, nan_to_null, null_profile
from perioda.plans import bills
from perioda.schemas import BILL_VALUES, INVOICE_COLUMNS

SCHEMA = "series_id bigint, bill_id bigint, dt date, " + ", ".join(f"{c} double" for c in BILL_VALUES)


def bill(series, number, date, **values):
    return (series, number, day(date), *[values.get(name) for name in BILL_VALUES])


PARTS = dict(grid_amt=100.0, trade_amt=50.0, heat_amt=30.0)


def test_total_adds_vat_to_small_fees_only(make):
    df = make(
        [
            bill(1, 1, "2024-01-01", **PARTS, service_fee=60.0),
            bill(1, 2, "2024-01-02", **PARTS, service_fee=70.0),
            bill(1, 3, "2024-01-03", **PARTS),
            bill(1, 4, "2024-01-04", trade_amt=50.0, heat_amt=30.0, service_fee=60.0),
        ],
        SCHEMA,
    )
    assert rows(bills.bill_total(df), "bill_id", "total_cost") == [(1, 255.0), (2, 250.0), (3, None), (4, None)]


def test_nan_fee_is_left_alone_and_ends_as_null(make):
    df = make([bill(1, 1, "2024-01-01", **PARTS, service_fee=math.nan)], SCHEMA)
    assert rows(bills.normalize_bills(df), "service_fee", "total_cost") == [(None, None)]


@pytest.mark.parametrize("plan", ["window", "blocked", "auto"])
def test_backfill_takes_the_next_value(make, plan):
    values = [None, 5.0, math.nan, 7.0, None]
    df = make([(1, i, day(f"2024-01-0{i + 1}"), v) for i, v in enumerate(values)], "s int, id int, dt date, x double")
    filled = backfill(nan_to_null(df), ["x"], series=["s"], order="dt", tie="id", plan=plan, block_rows=2)
    assert [r[1] for r in rows(filled, "id", "x")] == [5.0, 5.0, 7.0, 7.0, None]


def test_dedup_keeps_the_lowest_id(make):
    df = make([bill(1, 9, "2024-01-01"), bill(1, 4, "2024-01-01"), bill(2, 7, "2024-01-01")], SCHEMA)
    assert rows(bills.dedup_bills(df), "series_id", "bill_id") == [(1, 4), (2, 7)]


def test_normalize_fills_across_bills_of_one_date_and_series_apart(make):
    df = make(
        [
            bill(1, 1, "2024-01-01", usage_kwh=None),
            bill(1, 2, "2024-01-01", usage_kwh=4.0),
            bill(1, 3, "2024-02-01", usage_kwh=8.0, usage_mwh=1.0),
            bill(2, 4, "2024-01-01"),
        ],
        SCHEMA,
    )
    assert rows(bills.normalize_bills(df), "series_id", "bill_id", "usage_kwh", "usage_mwh") == [
        (1, 1, 4.0, 1.0),
        (1, 3, 8.0, 1.0),
        (2, 4, None, None),
    ]


def test_missing_total_copies_the_next_one_unless_recomputed(make):
    df = make(
        [
            bill(1, 1, "2024-01-01", trade_amt=1.0, heat_amt=1.0, service_fee=80.0),
            bill(1, 2, "2024-02-01", grid_amt=10.0, trade_amt=20.0, heat_amt=30.0, service_fee=80.0),
        ],
        SCHEMA,
    )
    assert rows(bills.normalize_bills(df), "bill_id", "total_cost") == [(1, 140.0), (2, 140.0)]
    assert rows(bills.normalize_bills(df, recompute_total=True), "bill_id", "total_cost") == [(1, 92.0), (2, 140.0)]


def test_period_of_nulls_sums_to_zero_and_has_no_mean(make):
    df = bills.normalize_bills(make([bill(1, 1, "2024-01-05")], SCHEMA))
    assert rows(bills.cost_by_period(df, "month"), "period", "total_cost", "usage_kwh", "spot_price") == [
        (day("2024-01-01"), 0.0, 0.0, None)
    ]


def test_grains_and_minute_alias(make):
    df = bills.normalize_bills(make([bill(1, 1, "2024-01-03", usage_kwh=1.0), bill(1, 2, "2024-05-30")], SCHEMA))
    starts = lambda grain: [r[0].isoformat() for r in rows(bills.cost_by_period(df, grain), "period")]
    assert starts("1m") == ["2024-01-03", "2024-05-30"]
    assert starts("week") == ["2024-01-01", "2024-05-27"]
    assert starts("quarter") == ["2024-01-01", "2024-04-01"]
    assert starts("1y") == ["2024-01-01"]
    with pytest.raises(ValueError):
        bills.cost_by_period(df, "fortnight")


def test_first_cut_period_drops_out(make):
    df = bills.normalize_bills(make([bill(1, i, f"2024-0{i}-20", usage_kwh=1.0) for i in (1, 2, 3)], SCHEMA))
    kept = bills.cost_by_period(df, "month", start=day("2024-01-15"), end=day("2024-03-10"))
    assert rows(kept, "period") == [(day("2024-02-01"),), (day("2024-03-01"),)]
    after = bills.cost_by_period(df, "month").filter(F.col("period").between(day("2024-01-15"), day("2024-03-10")))
    assert rows(after) == rows(kept)


def test_share_pairs_equal_sums_by_name(make):
    df = make([bill(1, 1, "2023-06-01", grid_amt=50.0, trade_amt=50.0, heat_amt=100.0)], SCHEMA)
    share = bills.cost_share(df, dt.date(2024, 3, 1))
    assert rows(share, "category", "percentage") == [("grid_amt", 25.0), ("heat_amt", 50.0), ("trade_amt", 25.0)]


def test_share_of_nothing_is_null_and_thousands_are_marked(make):
    empty = bills.cost_share(make([], SCHEMA), dt.date(2024, 3, 1))
    assert [r[1:] for r in rows(empty, "category", "amount", "percentage")] == [(0.0, None)] * 3
    big = make([bill(1, 1, "2023-06-01", grid_amt=1234567.5, trade_amt=2.5, heat_amt=999.4)], SCHEMA)
    assert dict(rows(bills.cost_share(big, dt.date(2024, 1, 1)), "category", "amount_text")) == {
        "grid_amt": "1_234_568",
        "trade_amt": "2",
        "heat_amt": "999",
    }


def test_unit_prices_and_years(make):
    prices = {c: 1.0 for c in BILL_VALUES}
    df = bills.normalize_bills(make([bill(1, 1, "2023-12-31", **prices), bill(1, 2, "2024-01-01", **prices)], SCHEMA))
    assert bills.unit_price_long(df, "year").count() == 10
    assert [r.year for r in bills.distinct_years(df).collect()] == [2023, 2024]
    assert rows(bills.year_compare(df, "usage_kwh", [2023]), "year", "month", "label", "value") == [
        (2023, 12, "Dec", 1.0)
    ]
    assert bills.year_compare(df, "usage_kwh", []).count() == 0
    assert rows(bills.month_forecast(df, dt.date(2030, 1, 9))) == [(4.0,)]


def test_invoices_with_export_headings(make):
    titles = list(INVOICE_COLUMNS)
    schema = ", ".join(f"`{t}` {'string' if t == 'date' else 'double'}" for t in titles)
    raw = make([("2024-01-01", *[1.0] * (len(titles) - 1)), ("2024-02-01", *[2.0] * (len(titles) - 1))], schema)
    normal = bills.normalize_bills(bills.from_invoices(raw, series_id=7))
    assert rows(normal, "series_id", "dt", "total_cost") == [(7, day("2024-01-01"), 4.0), (7, day("2024-02-01"), 9.0)]
    merged = bills.ingest_bills(normal, bills.from_invoices(raw, series_id=7))
    assert rows(merged) == rows(normal)


def test_null_profile(make):
    assert rows(null_profile(make([(1, None), (None, None)], "a int, `b.c` int"))) == [("a", 1), ("b.c", 2)]
