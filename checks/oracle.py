"""Standard SQL for every query, over the driver's tables."""

from __future__ import annotations

BILLS = """bills AS (
  SELECT o.o_custkey % 50 AS series_id, o.o_orderkey AS bill_id, CAST(o.o_orderdate AS DATE) AS dt,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE l.grid END AS grid_amt, l.trade AS trade_amt,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE l.heat END AS heat_amt,
    CAST(o.o_orderkey % 140 AS DOUBLE) AS service_fee, l.qty AS usage_kwh, l.qty / 64 AS usage_mwh,
    CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(o.o_orderkey % 90 AS DOUBLE) / 4 END AS spot_price,
    CAST(o.o_orderkey % 37 AS DOUBLE) / 8 AS tax_price, CAST(o.o_orderkey % 41 AS DOUBLE) / 8 AS transfer_price,
    CAST(o.o_orderkey % 29 AS DOUBLE) / 16 AS variable_price, CAST(o.o_orderkey % 23 AS DOUBLE) / 16 AS markup_price,
    CAST(o.o_orderkey % 800 AS DOUBLE) / 2 AS heat_price
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS grid,
      CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS DOUBLE) AS trade,
      CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) AS heat, SUM(l_quantity) AS qty
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

ACTIVITIES = """activities AS (
  SELECT event_id AS activity_id, user_id AS subject_id, ts AS dt, event_type AS activity,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * 100 END AS distance,
    CAST((event_id * 37) % 5400 + 300 AS DOUBLE) AS duration,
    CAST((event_id * 13) % 900 AS DOUBLE) AS secs_zone1, CAST((event_id * 26) % 900 AS DOUBLE) AS secs_zone2,
    CAST((event_id * 39) % 900 AS DOUBLE) AS secs_zone3, CAST((event_id * 52) % 900 AS DOUBLE) AS secs_zone4,
    CAST((event_id * 65) % 900 AS DOUBLE) AS secs_zone5 FROM events)"""

METRICS = """metrics AS (
  SELECT user_id % 5 AS subject_id, CAST(ts AS DATE) AS dt,
    CASE event_type WHEN 'click' THEN 'bodymass' WHEN 'view' THEN 'bodyfatpercentage'
      WHEN 'error' THEN 'bloodpressuresystolic' WHEN 'signup' THEN 'bloodpressurediastolic'
      ELSE 'distancewalkingrunning' END AS metric,
    CASE event_type WHEN 'click' THEN 'kg' WHEN 'view' THEN '%' WHEN 'error' THEN 'mmHg' WHEN 'signup' THEN 'mmHg'
      ELSE 'km' END AS unit,
    CASE event_type WHEN 'click' THEN CAST(60 + event_id % 40 AS DOUBLE)
      WHEN 'view' THEN CAST(event_id % 32 AS DOUBLE) / 64
      WHEN 'error' THEN CAST(100 + event_id % 60 AS DOUBLE) WHEN 'signup' THEN CAST(60 + event_id % 40 AS DOUBLE)
      ELSE CAST(event_id % 50 AS DOUBLE) / 8 END AS value FROM events)"""

GYM = """gym AS (
  SELECT CAST(o_orderdate AS DATE) AS dt,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Barbell Bench Press' WHEN '2-HIGH' THEN 'Barbell Squat'
      WHEN '3-MEDIUM' THEN 'Barbell Deadlift' WHEN '5-LOW' THEN 'Barbell Preacher Curl' ELSE 'Other' END AS exercise,
    CAST(o_orderkey % 400 AS DOUBLE) / 4 AS rep_max,
    CAST(o_orderkey % 100 AS VARCHAR) || 'x12,' || CAST(o_orderkey % 50 AS VARCHAR) || 'x10' AS sets_text,
    o_orderkey AS row_id FROM orders)"""

SAMPLES = """samples AS (
  SELECT user_id AS subject_id, event_id AS sample_id, ts, CAST(ts AS DATE) AS day,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 60 + event_id % 150 END AS hr, 1950 + user_id % 50 AS birth_year
  FROM events)"""

_FILL = ("grid_amt", "trade_amt", "heat_amt", "service_fee", "usage_kwh", "usage_mwh", "transfer_price", "tax_price",
         "spot_price", "variable_price", "markup_price", "heat_price", "total_cost")


def normal(source: str, name: str) -> str:
    """Row-wise statement of the normalised bills: total, fill, one row per date."""
    fills = ",\n    ".join(f"first_value({c} IGNORE NULLS) OVER ahead AS {c}" for c in _FILL)
    return f"""{name}_total AS (
  SELECT *, round(grid_amt + trade_amt + heat_amt
    + CASE WHEN service_fee < 70 THEN service_fee * 1.25 ELSE service_fee END) AS total_cost FROM {source}),
{name}_filled AS (
  SELECT series_id, bill_id, dt, {fills} FROM {name}_total
  WINDOW ahead AS (PARTITION BY series_id ORDER BY dt, bill_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, dt ORDER BY bill_id) AS place FROM {name}_filled)
  WHERE place = 1)"""


NORMAL = BILLS + ",\n" + normal("bills", "normal")


def r2(column: str) -> str:
    return f"round(avg({column}) * 100) / 100 AS {column}"


PRICES = ("transfer_price", "tax_price", "spot_price", "variable_price", "markup_price")


def period_cost(grain: str) -> str:
    prices = ", ".join(r2(c) for c in (*PRICES, "heat_price"))
    return f"""cost AS (
  SELECT series_id, CAST(date_trunc('{grain}', dt) AS DATE) AS period, coalesce(sum(total_cost), 0) AS total_cost,
    round(coalesce(sum(usage_kwh), 0)) AS usage_kwh, round(coalesce(sum(usage_mwh), 0) * 100) / 100 AS usage_mwh,
    {prices} FROM normal GROUP BY ALL)"""


def r6(expression: str, name: str) -> str:
    return f"round(({expression}) * 1e6) / 1e6 AS {name}"


PACE = "CASE WHEN distance = 0 THEN NULL ELSE (duration / 60) / (distance / 1000) END"

_LOW = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9)
_HIGH = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def zone_secs(activities: str, samples: str, join: str) -> str:
    """Seconds per zone by pairing every activity with its samples."""
    sums = ",\n    ".join(
        f"CAST(coalesce(sum(CASE WHEN s.hr >= round_even(CAST({lo} AS DOUBLE) * s.top, 0)"
        f" AND s.hr < round_even(CAST({hi} AS DOUBLE) * s.top, 0) THEN s.secs END), 0) AS BIGINT) AS secs_hr_zone{z}"
        for z, (lo, hi) in enumerate(zip(_LOW, _HIGH))
    )
    return f"""timed AS (
  SELECT *, 220 - (year(ts) - birth_year) AS top,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY subject_id, day ORDER BY ts, sample_id))) // 1000000 AS secs
  FROM {samples}),
pulse AS (
  SELECT a.subject_id, a.activity_id, {sums}
  FROM {activities} a LEFT JOIN timed s ON s.subject_id = a.subject_id {join}
    AND s.ts >= a.dt AND s.ts < a.dt + to_microseconds(CAST(a.duration * 1000000 AS BIGINT))
  GROUP BY ALL)"""


DOCUMENT_SAMPLES = SAMPLES + """,
doc_samples AS (
  SELECT subject_id, coalesce(hr, -1) AS sample_id, date_trunc('milliseconds', ts) AS ts, day, hr, birth_year
  FROM samples WHERE ts >= TIMESTAMP '2024-01-10')"""

MEAN_DAYS = """days AS (
  SELECT subject_id, dt, {columns} FROM metrics WHERE metric IN ({names}) GROUP BY subject_id, dt)"""


def mean_days(names: dict[str, str]) -> str:
    columns = ", ".join(f"avg(CASE WHEN metric = '{m}' THEN value END) AS {c}" for m, c in names.items())
    return MEAN_DAYS.format(columns=columns, names=", ".join(f"'{m}'" for m in names))


BP = METRICS + ",\n" + mean_days({"bloodpressuresystolic": "systolic", "bloodpressurediastolic": "diastolic"})
BP_DAY = BP + """,
pressure AS (SELECT subject_id, CAST(date_trunc('day', dt) AS DATE) AS period, avg(systolic) AS systolic,
  avg(diastolic) AS diastolic FROM days GROUP BY ALL)"""
WEIGHT = METRICS + ",\n" + mean_days({"bodymass": "bodymass", "bodyfatpercentage": "bodyfatpercentage"}) + """,
weight_fat AS (SELECT subject_id, CAST(date_trunc('day', dt) AS DATE) AS period, avg(bodymass) AS bodymass,
  avg(bodyfatpercentage) AS bodyfatpercentage FROM days GROUP BY ALL)"""

_AROUND = "(PARTITION BY subject_id ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


def trend(source: str, value: str, out: str, keep: str) -> str:
    return f"""smooth AS (
  SELECT subject_id, period, {source}, CASE WHEN count({value}) OVER {_AROUND} = 3
    THEN avg({value}) OVER {_AROUND} END AS smooth FROM weight_fat {keep}),
trend AS (SELECT subject_id, period, {source}, coalesce(smooth, avg(smooth) OVER (PARTITION BY subject_id)) AS {out}
  FROM smooth)"""


LEGACY = """legacy AS (
  SELECT o_orderkey AS row_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Löpning' WHEN '2-HIGH' THEN 'Promenad' ELSE 'Simning' END AS form,
    o_orderkey % 90 AS minutes, o_orderkey % 60 AS seconds, o_orderkey % 250 AS tenths, o_orderkey % 1500 AS kcal,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 156 MONTH AS DATE) AS day FROM orders),
imported AS (
  SELECT CAST(day AS TIMESTAMP) AS dt, CAST(tenths AS DOUBLE) / 10 * 10 AS distance,
    CAST(minutes * 60 + seconds AS DOUBLE) AS duration, CAST(kcal AS DOUBLE) AS calories,
    CASE form WHEN 'Löpning' THEN 'running' WHEN 'Promenad' THEN 'walking' END AS activity
  FROM legacy WHERE form <> 'Simning' AND day <= DATE '2014-10-01')"""

REPAIRED = """SELECT {columns} FROM (
  SELECT * REPLACE (CASE WHEN dt <= DATE '2015-01-01' AND distance <= 900 THEN distance * 100 ELSE distance END
    AS distance) FROM {source})
WHERE distance > 100 AND duration > 10 AND distance / nullif(duration, 0) <= 10"""

OLD_GYM = "dt < DATE '2000-01-01'"
NEW_GYM = "dt >= DATE '1998-01-01'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


ORACLE: dict[str, str] = {
    # bills
    "bill_total": _with(BILLS, """SELECT series_id, bill_id, dt, round(grid_amt + trade_amt + heat_amt
  + CASE WHEN service_fee < 70 THEN service_fee * 1.25 ELSE service_fee END) AS total_cost FROM bills"""),
    "dedup_bills": _with(BILLS, """SELECT series_id, dt, min(bill_id) AS bill_id FROM bills GROUP BY series_id, dt"""),
    "backfill": _with(BILLS, """SELECT series_id, bill_id, dt, first_value(grid_amt IGNORE NULLS) OVER ahead AS grid_amt,
  first_value(heat_amt IGNORE NULLS) OVER ahead AS heat_amt, first_value(spot_price IGNORE NULLS) OVER ahead AS spot_price
FROM bills
WINDOW ahead AS (PARTITION BY series_id ORDER BY dt, bill_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "normalize_bills": _with(NORMAL, "SELECT * FROM normal"),
    "cost_by_period": _with(NORMAL, period_cost("month"), "SELECT * FROM cost"),
    "cost_by_period_range": _with(NORMAL, period_cost("quarter"),
        "SELECT * FROM cost WHERE period BETWEEN DATE '1996-02-10' AND DATE '1998-07-31'"),
    "from_invoices": _with(BILLS, "SELECT * FROM bills"),
    "consumption_by_period": _with(NORMAL, period_cost("year"),
        "SELECT series_id, period, usage_kwh, usage_mwh FROM cost"),
    "heat_price_by_period": _with(NORMAL, period_cost("quarter"), "SELECT series_id, period, heat_price FROM cost"),
    "unit_price_long": _with(NORMAL, period_cost("month"), " UNION ALL ".join(
        f"SELECT series_id, period, '{c}' AS cost_type, {c} AS cost FROM cost" for c in PRICES)),
    "distinct_years": _with(NORMAL, "SELECT DISTINCT CAST(year(dt) AS INTEGER) AS year FROM normal"),
    **{
        f"year_compare_{short}": _with(NORMAL, f"""SELECT series_id, dt, CAST(year(dt) AS INTEGER) AS year,
  CAST(month(dt) AS INTEGER) AS month,
  ['Jan','Feb','Mar','Apr','Maj','Jun','Jul','Aug','Sep','Okt','Nov','Dec'][month(dt)] AS label, {measure} AS value
FROM normal WHERE year(dt) IN (1996, 1999, 2000)""")
        for short, measure in (("cost", "total_cost"), ("kwh", "usage_kwh"), ("mwh", "usage_mwh"))
    },
    "cost_share": _with(NORMAL, """sums AS (SELECT sum(grid_amt) AS grid_amt, sum(trade_amt) AS trade_amt,
  sum(heat_amt) AS heat_amt FROM normal WHERE year(dt) = 2000)""", """SELECT category, amount,
  amount / (SELECT grid_amt + trade_amt + heat_amt FROM sums) * 100 AS percentage,
  replace(format('{:,}', CAST(round_even(amount, 0) AS BIGINT)), ',', '_') AS amount_text
FROM (SELECT 'grid_amt' AS category, grid_amt AS amount FROM sums UNION ALL SELECT 'trade_amt', trade_amt FROM sums
  UNION ALL SELECT 'heat_amt', heat_amt FROM sums)"""),
    "month_forecast": _with(NORMAL, """SELECT series_id, round_even(avg(total_cost), 0) AS forecast FROM normal
WHERE month(dt) = 3 GROUP BY series_id"""),
    "null_profile": _with(BILLS, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM bills"
        for c in ("series_id", "bill_id", "dt", "grid_amt", "trade_amt", "heat_amt", "service_fee", "usage_kwh",
                  "usage_mwh", "spot_price", "tax_price", "transfer_price", "variable_price", "markup_price",
                  "heat_price"))),
    "ingest_bills": _with(BILLS, f"old_bills AS (SELECT * FROM bills WHERE {OLD_GYM})",
        f"new_bills AS (SELECT * FROM bills WHERE {NEW_GYM})", normal("old_bills", "old_normal"),
        normal("new_bills", "new_normal"), "SELECT * FROM old_normal UNION SELECT * FROM new_normal"),
    # activities
    "activity_counts": _with(ACTIVITIES, "SELECT activity, count(*) AS count FROM activities GROUP BY activity"),
    "activity_types": _with(ACTIVITIES, "SELECT DISTINCT activity FROM activities"),
    "distance_buckets": _with(ACTIVITIES, """SELECT CAST(date_trunc('week', dt) AS DATE) AS period,
  CASE WHEN distance / 1000 < 2.8 THEN '<3km' WHEN distance / 1000 < 5.8 THEN '3-5km'
    WHEN distance / 1000 < 10 THEN '6-10km' ELSE '>10km' END AS distance_range, count(activity) AS activity_count
FROM activities WHERE activity = 'click' GROUP BY ALL"""),
    "active_days_by_kind": _with(ACTIVITIES, GYM, """SELECT CAST(date_trunc('month', day) AS DATE) AS period,
  count(*) AS count, category FROM (
    SELECT DISTINCT dt AS day, 'gym' AS category FROM gym
    UNION ALL SELECT DISTINCT CAST(dt AS DATE), 'click' FROM activities WHERE activity = 'click') GROUP BY ALL"""),
    "walk_run_distance": _with(ACTIVITIES, METRICS, f"""SELECT CAST(date_trunc('week', dt) AS DATE) AS period,
  {r6('sum(value)', 'value')}, 'walk' AS type FROM metrics WHERE metric = 'distancewalkingrunning' GROUP BY 1
UNION ALL SELECT CAST(date_trunc('week', dt) AS DATE), {r6('sum(distance) / 1000', 'value')}, 'run'
FROM activities WHERE activity = 'click' GROUP BY 1"""),
    "walk_run_distance_daily": _with(ACTIVITIES, METRICS, f"""SELECT CAST(date_trunc('week', dt) AS DATE) AS period,
  value, 'walk' AS type FROM (SELECT dt, {r6('sum(value)', 'value')} FROM metrics
    WHERE metric = 'distancewalkingrunning' GROUP BY dt)
UNION ALL SELECT CAST(date_trunc('week', dt) AS DATE), {r6('sum(distance) / 1000', 'value')}, 'run'
FROM activities WHERE activity = 'click' GROUP BY 1"""),
    "distance_histogram": _with(ACTIVITIES, """SELECT round(distance / 1000) AS distance_km, count(*) AS count
FROM activities WHERE activity = 'click' GROUP BY 1"""),
    "pace_records": _with(ACTIVITIES, f"""SELECT dt, CAST(CAST(trunc(m) AS BIGINT) AS VARCHAR) || ':' ||
  lpad(CAST(CAST(trunc((m - trunc(m)) * 60) AS BIGINT) AS VARCHAR), 2, '0') AS pace
FROM (SELECT dt, {PACE} AS m FROM activities WHERE activity = 'click' AND distance BETWEEN 5800 AND 6200)"""),
    "longest_activities": _with(ACTIVITIES, "SELECT dt, round(distance / 1000) AS km, activity FROM activities"),
    "longest_runs": _with(ACTIVITIES, """SELECT round(distance / 1000 * 10) / 10 AS km, duration AS duration_secs,
  CAST(dt AS DATE) AS day FROM activities WHERE activity = 'click' AND distance IS NOT NULL
ORDER BY distance DESC, dt, activity_id LIMIT 10"""),
    "fastest_in_band": _with(ACTIVITIES, """SELECT round(duration / 60) AS minutes, CAST(dt AS DATE) AS day
FROM activities WHERE activity = 'click' AND distance BETWEEN 5800 AND 6200
ORDER BY round(duration / 60), dt, activity_id LIMIT 10"""),
    "pace_by_period": _with(ACTIVITIES, f"""SELECT CAST(date_trunc('week', dt) AS DATE) AS period,
  {r6(f'median({PACE})', 'median_mins_per_km')} FROM activities WHERE activity = 'click' GROUP BY 1"""),
    "pace_bounds": _with(ACTIVITIES, f"""medians AS (SELECT date_trunc('week', dt), median({PACE}) AS m
  FROM activities WHERE activity = 'click' GROUP BY 1)""",
        f"SELECT {r6('min(m) - 0.5', 'low')}, {r6('max(m) + 0.5', 'high')} FROM medians"),
    "zone_medians": _with(ACTIVITIES, "SELECT CAST(date_trunc('week', dt) AS DATE) AS period, " + ", ".join(
        r6(f"median(secs_zone{n} / 60)", f"median_zone{n}") for n in range(1, 6))
        + " FROM activities WHERE activity = 'click' GROUP BY 1"),
    "zone_medians_long": _with(ACTIVITIES, " UNION ALL ".join(
        f"SELECT CAST(date_trunc('week', dt) AS DATE) AS period, 'median_zone{n}' AS zone, "
        + r6(f"median(secs_zone{n} / 60)", "median_time") + " FROM activities WHERE activity = 'click' GROUP BY 1"
        for n in range(1, 6))),
    "stream_totals": """SELECT user_id % 5 AS subject_id, CAST(date_trunc('week', ts) AS DATE) AS period,
  CAST(count(*) AS BIGINT) AS rows,
  sum(CASE event_type WHEN 'click' THEN CAST(60 + event_id % 40 AS DOUBLE)
    WHEN 'view' THEN CAST(event_id % 32 AS DOUBLE) / 64 WHEN 'error' THEN CAST(100 + event_id % 60 AS DOUBLE)
    WHEN 'signup' THEN CAST(60 + event_id % 40 AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) / 8 END) AS value
  FROM events GROUP BY ALL""",
    "zone_medians_sketched": _with(ACTIVITIES, """SELECT CAST(date_trunc('week', dt) AS DATE) AS period, count(*) AS n,
  TRUE AS secs_mid_near, TRUE AS distance_mid_near, TRUE AS distance_high_near
  FROM activities WHERE activity = 'click' GROUP BY 1"""),
    "zone_bounds": _with(SAMPLES, "people AS (SELECT DISTINCT birth_year, year(ts) AS year FROM samples)",
        " UNION ALL ".join(
            f"SELECT birth_year, year, CAST({z} AS BIGINT) AS zone,"
            f" CAST(round_even(CAST({lo} AS DOUBLE) * (220 - (year - birth_year)), 0) AS BIGINT) AS low,"
            f" CAST(round_even(CAST({hi} AS DOUBLE) * (220 - (year - birth_year)), 0) AS BIGINT) AS high FROM people"
            for z, (lo, hi) in enumerate(zip(_LOW, _HIGH)))),
    "hr_secs_in_zone": _with(ACTIVITIES, SAMPLES, """odd AS (SELECT * REPLACE (CASE
  WHEN activity_id % 83 = 0 THEN NULL WHEN activity_id % 89 = 0 THEN -duration ELSE duration END AS duration)
  FROM activities)""", zone_secs("odd", "samples", "AND s.day = CAST(a.dt AS DATE)"),
        "SELECT odd.subject_id, odd.activity_id, " + ", ".join(
            f"CASE WHEN duration >= 0 THEN secs_hr_zone{z} END AS secs_hr_zone{z}" for z in range(6))
        + " FROM odd JOIN pulse USING (activity_id)"),
    "hr_secs_in_zone_past_midnight": _with(ACTIVITIES, SAMPLES, zone_secs("activities", "samples", ""),
        "SELECT * FROM pulse"),
    "zone_enrich": _with(ACTIVITIES, """SELECT activity_id, subject_id, dt, activity, distance, duration, secs_zone1,
  secs_zone2, secs_zone3, secs_zone4, secs_zone5 FROM activities"""),
    "date_spine": _with(ACTIVITIES, """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(
  (SELECT CAST(min(dt) AS DATE) FROM activities)::TIMESTAMP, TIMESTAMP '2024-02-09', INTERVAL 1 DAY)) AS d)"""),
    "missing_days": _with(ACTIVITIES, """spine AS (SELECT subject_id, CAST(unnest(generate_series(
  CAST(CAST(min(dt) AS DATE) AS TIMESTAMP), TIMESTAMP '2024-02-09', INTERVAL 1 DAY)) AS DATE) AS day
  FROM activities GROUP BY subject_id)""", """SELECT subject_id, day FROM spine s WHERE NOT EXISTS (
  SELECT 1 FROM activities a WHERE a.subject_id = s.subject_id AND CAST(a.dt AS DATE) = s.day)"""),
    "period_slice": _with(ACTIVITIES, """SELECT activity_id, dt FROM activities
WHERE dt BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:30:00.250'"""),
    "date_range": _with(ACTIVITIES, """SELECT activity_id, dt FROM activities
WHERE dt >= DATE '2024-01-05' AND dt <= DATE '2024-01-20'"""),
    # metrics
    "bp_by_period": _with(BP, f"""SELECT subject_id, CAST(date_trunc('week', dt) AS DATE) AS period,
  {r6('avg(systolic)', 'systolic')}, {r6('avg(diastolic)', 'diastolic')} FROM days GROUP BY 1, 2"""),
    "bp_by_period_range": _with(BP, f"""SELECT subject_id, CAST(date_trunc('week', dt) AS DATE) AS period,
  {r6('avg(systolic)', 'systolic')}, {r6('avg(diastolic)', 'diastolic')} FROM days
  WHERE dt BETWEEN DATE '2024-01-04' AND DATE '2024-01-20' GROUP BY 1, 2"""),
    "bp_extremes": _with(BP_DAY, """SELECT * FROM (SELECT 'highest' AS kind, subject_id, period,
  round(systolic * 10) / 10 AS systolic, round(diastolic * 10) / 10 AS diastolic FROM pressure
  WHERE diastolic IS NOT NULL ORDER BY pressure.diastolic DESC, period, subject_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'lowest' AS kind, subject_id, period, round(systolic * 10) / 10 AS systolic,
  round(diastolic * 10) / 10 AS diastolic FROM pressure
  WHERE diastolic IS NOT NULL ORDER BY pressure.diastolic, period, subject_id LIMIT 5)"""),
    "weight_fat_by_period": _with(WEIGHT, f"""SELECT subject_id, CAST(date_trunc('week', dt) AS DATE) AS period,
  {r6('avg(bodymass)', 'bodymass')}, {r6('avg(bodyfatpercentage)', 'bodyfatpercentage')} FROM days GROUP BY 1, 2"""),
    "weight_trend": _with(WEIGHT, trend("bodymass", "bodymass", "weight", "WHERE bodymass >= 70"),
        f"SELECT subject_id, period, {r6('bodymass', 'bodymass')}, {r6('weight', 'weight')} FROM trend"),
    "fat_trend": _with(WEIGHT, trend("bodyfatpercentage", "bodyfatpercentage * 100", "fat", ""),
        f"SELECT subject_id, period, {r6('bodyfatpercentage', 'bodyfatpercentage')}, {r6('fat', 'fat')} FROM trend"),
    "trend_bounds": _with(WEIGHT, f"""SELECT subject_id, {r6('min(bodyfatpercentage) * 100', 'low')},
  {r6('max(bodyfatpercentage) * 100', 'high')} FROM weight_fat GROUP BY subject_id"""),
    # strength
    "gym_counts": _with(GYM, "SELECT exercise, count(*) AS count FROM gym GROUP BY exercise"),
    "gym_max_wide": _with(GYM, "SELECT CAST(date_trunc('month', dt) AS DATE) AS month, " + ", ".join(
        f"max(CASE WHEN exercise = '{e}' THEN rep_max END) AS {c}" for e, c in (
            ("Barbell Bench Press", "bench_press"), ("Barbell Squat", "squat"), ("Barbell Deadlift", "deadlift"),
            ("Barbell Preacher Curl", "preacher_curl"), ("Other", "other"))) + " FROM gym GROUP BY 1"),
    "gym_max_by_month": _with(GYM, """SELECT CAST(date_trunc('month', dt) AS DATE) AS month, exercise,
  max(rep_max) AS rep_max FROM gym WHERE exercise <> 'Other' GROUP BY 1, 2"""),
    "gym_best": _with(GYM, "SELECT exercise, max(rep_max) AS rep_max FROM gym WHERE exercise <> 'Other' GROUP BY 1"),
    "gym_top5": _with(GYM, """SELECT exercise, dt, rep_max, sets_text, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY exercise ORDER BY rep_max DESC, dt, row_id) AS place FROM gym
  WHERE exercise IN ('Barbell Bench Press', 'Barbell Squat')) WHERE place <= 5"""),
    # coverage
    "source_coverage": _with(ACTIVITIES, GYM, METRICS, " UNION ALL ".join(
        f"""SELECT '{name}' AS source, CAST(min(dt) AS DATE) AS first_day, CAST(max(dt) AS DATE) AS last_day,
  CAST(year(max(dt)) - year(min(dt)) AS BIGINT) AS years, count(*) AS rows FROM {name}"""
        for name in ("activities", "metrics", "gym"))),
    # scalar functions and repairs
    "parse_dates": """SELECT event_id, ts AS dt, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d') AS iso_day FROM events""",
    "recode_activity": _with(LEGACY, "SELECT * FROM imported"),
    "quality_repair": _with(ACTIVITIES, REPAIRED.format(
        columns="activity_id, dt, distance, duration", source="activities")),
    "ingest_legacy_activities": _with(ACTIVITIES, LEGACY, """merged AS (
  SELECT activity_id, subject_id, dt, activity, distance, duration, CAST(NULL AS DOUBLE) AS calories FROM activities
  UNION SELECT NULL, NULL, dt, activity, distance, duration, calories FROM imported)""", REPAIRED.format(
        columns="*", source="merged")),
    # merges
    "merge_align": _with(ACTIVITIES, """old AS (SELECT DISTINCT activity_id, dt, activity, distance, duration
  FROM activities WHERE dt < TIMESTAMP '2024-01-20')""", """new AS (SELECT DISTINCT activity_id, dt, distance,
  secs_zone1, secs_zone2 FROM activities WHERE dt >= TIMESTAMP '2024-01-10')""",
        """SELECT DISTINCT coalesce(o.activity_id, n.activity_id) AS activity_id, coalesce(o.dt, n.dt) AS dt,
  coalesce(o.distance, n.distance) AS distance, o.activity, o.duration, n.secs_zone1, n.secs_zone2
FROM old o FULL JOIN new n ON o.activity_id = n.activity_id AND o.dt = n.dt AND o.distance = n.distance"""),
    "merge_diagonal": _with(ACTIVITIES, """SELECT subject_id, CAST(dt AS DATE) AS day, activity, NULL AS duration
FROM activities WHERE dt < TIMESTAMP '2024-01-20'
UNION SELECT subject_id, CAST(dt AS DATE), NULL, CAST(activity_id % 7 AS DOUBLE) FROM activities
WHERE dt >= TIMESTAMP '2024-01-10'"""),
    "merge_keep_existing": _with(GYM, f"""SELECT dt, exercise, rep_max, sets_text, side FROM (
  SELECT *, row_number() OVER (PARTITION BY dt, exercise, rep_max ORDER BY side DESC, row_id) AS place FROM (
    SELECT *, 'old' AS side FROM gym WHERE {OLD_GYM} UNION ALL SELECT *, 'new' FROM gym WHERE {NEW_GYM}))
WHERE place = 1"""),
    # sources and sinks
    "src_json_gym": _with(GYM, "SELECT dt, exercise, rep_max, sets_text FROM gym"),
    "src_json_gym_array": _with(GYM, "SELECT dt, exercise, rep_max, sets_text FROM gym"),
    "src_csv_section": _with(GYM, "SELECT dt, exercise, rep_max, sets_text FROM gym"),
    "src_csv_section_lines": _with(GYM, "SELECT dt, exercise, rep_max, sets_text FROM gym"),
    "src_json_activities": _with(ACTIVITIES, """SELECT activity_id, subject_id, dt, activity, distance, duration,
  secs_zone1, secs_zone2, secs_zone3, secs_zone4, secs_zone5, CAST(activity_id % 70 AS INTEGER) AS average_hr
  FROM activities"""),
    "src_json_undeclared": _with(ACTIVITIES, """SELECT activity_id, subject_id, dt, activity, distance, duration,
  CAST(activity_id % 13 AS DOUBLE) / 2 AS wind, 'sky ' || (activity_id % 3) AS sky,
  CASE WHEN activity_id % 1000 < 3 THEN activity_id % 7 END AS shoe,
  CASE WHEN activity_id % 1000 < 3 THEN activity_id % 5 END AS size
  FROM activities"""),
    "src_xml_metrics": _with(METRICS, "SELECT dt, metric, unit, value FROM metrics"),
    "src_xml_metrics_zip": _with(METRICS, "SELECT dt, metric, unit, value FROM metrics"),
    "src_html_rows": """SELECT page_id, CAST(item - 1 AS BIGINT) AS item, hrefs[item] AS href, labels[item] AS label FROM (
  SELECT page_id, hrefs, labels, unnest(range(1, len(hrefs) + 1)) AS item FROM (
    SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>\\s*<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
      regexp_extract_all(html, '(?is)<li\\b[^>]*>\\s*<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS labels
    FROM pages))""",
    "src_html_table": _with(LEGACY, """SELECT row_id, form, minutes, seconds, CAST(tenths AS DOUBLE) / 10 AS km, kcal, day
FROM legacy"""),
    "sink_roundtrip": _with(ACTIVITIES, "SELECT activity_id, subject_id, dt, activity, distance FROM activities"),
    "sink_merge_years": _with(GYM, f"""SELECT DISTINCT dt, exercise, rep_max, sets_text FROM gym
WHERE {OLD_GYM} OR {NEW_GYM}"""),
    "sink_versions": _with(GYM, f"""SELECT 1 AS version, dt, exercise, rep_max, sets_text FROM gym WHERE {OLD_GYM}
UNION ALL SELECT 2, dt, exercise, rep_max, sets_text FROM gym WHERE dt < DATE '1998-01-01'
UNION ALL SELECT DISTINCT 2, dt, exercise, rep_max, sets_text FROM gym WHERE {NEW_GYM}"""),
    "src_bad_files": _with(ACTIVITIES, "SELECT activity_id, subject_id, dt, activity, distance, 2 AS bad FROM activities"),
    "cost_after_merges": _with(NORMAL, period_cost("month"), "SELECT * FROM cost"),
    "coverage_after_merges": _with(NORMAL, """SELECT 'bills' AS source, CAST(min(dt) AS DATE) AS first_day,
  CAST(max(dt) AS DATE) AS last_day, year(max(dt)) - year(min(dt)) AS years, count(*) AS rows FROM normal"""),
    "load_or_empty": _with(GYM, "SELECT dt, exercise, rep_max, sets_text FROM gym"),
    "ingest_metrics": _with(METRICS, "SELECT DISTINCT dt, metric, unit, value FROM metrics"),
    "ingest_gym_json": _with(GYM, "SELECT DISTINCT dt, exercise, rep_max, sets_text FROM gym"),
    "ingest_gym_csv": _with(GYM, f"""SELECT dt, exercise, rep_max, sets_text FROM (
  SELECT *, row_number() OVER (PARTITION BY dt, exercise, rep_max ORDER BY side, sets_text) AS place FROM (
    SELECT *, 0 AS side FROM gym WHERE {OLD_GYM} UNION ALL SELECT *, 1 FROM gym WHERE {NEW_GYM}))
WHERE place = 1"""),
    "ingest_activities": _with(ACTIVITIES, DOCUMENT_SAMPLES, """doc_activities AS (
  SELECT * FROM activities WHERE dt >= TIMESTAMP '2024-01-10')""",
        zone_secs("doc_activities", "doc_samples", "AND s.day = CAST(a.dt AS DATE)"),
        """old AS (SELECT DISTINCT activity_id, subject_id, dt, activity, distance, duration FROM activities
  WHERE dt < TIMESTAMP '2024-01-20')""",
        """new AS (SELECT a.activity_id, a.subject_id, a.dt, a.activity, a.distance, a.duration, a.secs_zone1,
  a.secs_zone5, p.* EXCLUDE (subject_id, activity_id) FROM doc_activities a
  JOIN pulse p ON p.activity_id = a.activity_id AND p.subject_id = a.subject_id WHERE a.distance > 1000)""",
        """SELECT DISTINCT coalesce(o.activity_id, n.activity_id) AS activity_id,
  coalesce(o.subject_id, n.subject_id) AS subject_id, coalesce(o.dt, n.dt) AS dt,
  coalesce(o.activity, n.activity) AS activity, coalesce(o.distance, n.distance) AS distance,
  coalesce(o.duration, n.duration) AS duration, n.secs_zone1, n.secs_zone5, n.secs_hr_zone0, n.secs_hr_zone1,
  n.secs_hr_zone2, n.secs_hr_zone3, n.secs_hr_zone4, n.secs_hr_zone5
FROM old o FULL JOIN new n ON o.activity_id = n.activity_id AND o.subject_id = n.subject_id AND o.dt = n.dt
  AND o.activity = n.activity AND o.distance = n.distance AND o.duration = n.duration"""),
    "stream_ingest": _with(METRICS, "SELECT DISTINCT subject_id, dt, metric, unit, value FROM metrics"),
}
# What differs between these is how the rows come in, not what they give.
ORACLE["stream_hr_secs"] = ORACLE["hr_secs_in_zone"]
ORACLE["src_xml_metrics_zip_files"] = ORACLE["src_xml_metrics_zip"]
