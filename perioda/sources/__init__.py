from perioda.sources.html import html_items, html_table, read_html_tables
from perioda.sources.isolated import bad_files, read_readable
from perioda.sources.json import day_activities, day_pulse_samples, gym_history, read_day_documents, read_gym_json
from perioda.sources.open_json import open_activities, read_open_activities
from perioda.sources.json_arrays import read_json_array
from perioda.sources.sections import parse_csv_sections, read_csv_sections
from perioda.sources.tables import load_or_empty, merge_into_table, read_table, replace_table
from perioda.sources.versions import merge_version, read_version, refresh_derived, remove_old_versions, replace_version
from perioda.sources.xml import read_metrics_xml, read_metrics_zip

__all__ = [
    "bad_files",
    "day_activities",
    "day_pulse_samples",
    "gym_history",
    "html_items",
    "html_table",
    "load_or_empty",
    "merge_into_table",
    "merge_version",
    "open_activities",
    "parse_csv_sections",
    "read_csv_sections",
    "read_day_documents",
    "read_gym_json",
    "read_html_tables",
    "read_json_array",
    "read_metrics_xml",
    "read_metrics_zip",
    "read_open_activities",
    "read_readable",
    "read_table",
    "read_version",
    "refresh_derived",
    "remove_old_versions",
    "replace_table",
    "replace_version",
]
