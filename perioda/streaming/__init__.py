from perioda.streaming.ingest import stream_into_table
from perioda.streaming.pulse import answered, pulse_time_line, stream_pulse_seconds
from perioda.streaming.totals import daily_totals, stream_daily_totals, totals_by_period

__all__ = [
    "answered", "daily_totals", "pulse_time_line", "stream_daily_totals", "stream_into_table", "stream_pulse_seconds",
    "totals_by_period",
]
