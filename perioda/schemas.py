"""Declared schemas of the four tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_long, _double, _text = T.LongType(), T.DoubleType(), T.StringType()
_date, _clock = T.DateType(), T.TimestampNTZType()

# Invoice export column -> table column.
INVOICE_COLUMNS = {
    "date": "date",
    "Elnät totalt belopp (kr)": "grid_amt",
    "Elhandel totalt belopp (kr)": "trade_amt",
    "Fjärrvärme totalt belopp (kr)": "heat_amt",
    "Stadsnät serviceavgift villa (kr/st)": "service_fee",
    "El förbrukning (kWh)": "usage_kwh",
    "Fjärrvärme förbrukning (MWh)": "usage_mwh",
    "Elnät överföring enkeltariff (öre/kWh)": "transfer_price",
    "Elnät energiskatt (öre/kWh)": "tax_price",
    "Elhandel medelspotpris (öre/kWh)": "spot_price",
    "Elhandel rörliga kostnader (öre/kWh)": "variable_price",
    "Elhandel fasta påslag (öre/kWh)": "markup_price",
    "Fjärrvärme energiavgift (kr/MWh)": "heat_price",
}

AMOUNTS = ("grid_amt", "trade_amt", "heat_amt")
USAGE = ("usage_kwh", "usage_mwh")
UNIT_PRICES = ("transfer_price", "tax_price", "spot_price", "variable_price", "markup_price")
BILL_VALUES = (*AMOUNTS, "service_fee", *USAGE, *UNIT_PRICES, "heat_price")

BILLS = _struct(
    series_id=_long, bill_id=_long, dt=_date, **{name: _double for name in BILL_VALUES}, total_cost=_double
)

ZONE_SECONDS = tuple(f"secs_zone{n}" for n in range(1, 6))
HEART_ZONE_SECONDS = tuple(f"secs_hr_zone{n}" for n in range(6))

ACTIVITIES = _struct(
    activity_id=_long,
    subject_id=_long,
    dt=_clock,
    activity=_text,
    activity_name=_text,
    distance=_double,
    duration=_double,
    calories=_double,
    steps=_long,
    **{name: _double for name in ZONE_SECONDS},
)

METRICS = _struct(subject_id=_long, dt=_date, metric=_text, unit=_text, value=_double)

GYM = _struct(dt=_date, exercise=_text, rep_max=T.FloatType(), sets=T.ArrayType(_text))

# Raw gym history: numbers and dates arrive as text, the spelling is the export's.
RAW_GYM = _struct(date=_text, excercise=_text, rep_max=_text, sets=T.ArrayType(_text))

ZONE_LIST = T.ArrayType(_struct(zoneNumber=_long, secsInZone=_double))

RAW_ACTIVITY = _struct(
    activityId=_long,
    activityName=_text,
    startTimeLocal=_text,
    distance=_double,
    duration=_double,
    calories=_double,
    steps=_long,
    activityType=_struct(typeKey=_text),
    zones=ZONE_LIST,
)

# One document per subject and day; each heart rate sample is [epoch ms, rate or null].
RAW_DAY = _struct(
    subjectId=_long,
    birthYear=_long,
    ActivitiesForDay=_struct(payload=T.ArrayType(RAW_ACTIVITY)),
    AllDayHR=_struct(payload=_struct(heartRateValues=T.ArrayType(T.ArrayType(_long)))),
)
