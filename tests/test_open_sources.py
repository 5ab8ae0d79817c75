"""Undeclared JSON fields, cells over line ends, spans of cells, and versions of a table."""

import json
import random

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from perioda.operators import diagonal_merge
from perioda.schemas import GYM
from perioda.sources import (
    html_table,
    merge_version,
    parse_csv_sections,
    read_csv_sections,
    read_open_activities,
    read_version,
    remove_old_versions,
    replace_version,
    versions,
)


def document(*activities, subject=1):
    return {"subjectId": subject, "ActivitiesForDay": {"payload": list(activities)}, "AllDayHR": {"payload": {"heartRateValues": [[1, 60]]}}}


def activity(number, **more):
    return {"activityId": number, "startTimeLocal": "2024-01-01T10:00:00", "activityType": {"typeKey": "run"}, **more}


def test_all_keys_of_all_files_become_columns(spark, tmp_path):
    lines = [
        document(activity(1, weather={"wind": {"speed": 1}, "sky": "red"}, tags=["a", "b"])),
        document(activity(2, weather={"wind": {"speed": 2.5, "from": "N"}}, odd={"a.b": True, "it's": None}, mixed=1)),
        document(activity(3, mixed="x", Weather="upper", dt="taken", zones=[{"zoneNumber": 1, "secsInZone": 5}])),
        document(activity(4, activityType={"typeKey": "swim", "parent": {"id": 7}}, laps=[{"n": 1}, {"n": 2, "pace": 3.5}], empty={})),
        {"subjectId": 9},
        document(subject=8),
    ]
    (tmp_path / "a").write_text("\n".join(map(json.dumps, lines[:2])) + "\n\n")
    (tmp_path / "b").write_text("\n".join(map(json.dumps, lines[2:])))
    found = read_open_activities(spark, str(tmp_path))
    assert set(found.columns) >= {
        "Weather", "weather.wind.speed", "weather.wind.from", "weather.sky", "tags", "odd.a.b", "odd.it's", "mixed", "dt_", "activityType.parent.id",
        "laps", "empty", "has_pulse",
    }
    kinds = dict(found.dtypes)
    assert kinds["weather.wind.speed"] == "double" and kinds["mixed"] == "string" and kinds["odd.it's"] == "string"
    assert kinds["laps"] == "array<struct<n:bigint,pace:double>>" and kinds["activityType.parent.id"] == "bigint"
    names = ["activity_id", "activity", "`weather.wind.speed`", "`odd.a.b`", "mixed", "dt_", "`activityType.parent.id`", "secs_zone1"]
    assert rows(found, *names) == [
        (1, "run", 1.0, None, None, None, None, None), (2, "run", 2.5, True, "1", None, None, None),
        (3, "run", None, None, "x", "taken", None, 5.0), (4, "swim", None, None, None, None, 7, None),
    ]
    assert [[tuple(lap) for lap in r["laps"]] for r in found.filter("activity_id = 4").collect()] == [[(1, None), (2, 3.5)]]
    with pytest.raises(ValueError, match="further fields"):
        read_open_activities(spark, str(tmp_path), max_fields=3)


def test_documents_without_activities_or_further_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"subjectId": 9}, indent=1))
    found = read_open_activities(spark, str(tmp_path), multi_line=True)
    assert found.count() == 0 and "activity_id" in found.columns
    (tmp_path / "b.json").write_text(json.dumps(document(activity(1)), indent=1))
    assert rows(read_open_activities(spark, str(tmp_path), multi_line=True), "activity_id", "has_pulse") == [(1, True)]


HEAD = "### EXERCISE LOGS\n-\nnote,mydate,ename,record,logs\n"


def exported(seed, count):
    """Random logs with line ends, quotes and commas inside cells, as text and as rows."""
    rng, lines, expected = random.Random(seed), [], []
    for k in range(count):
        note = "".join(rng.choice(['a', ',', '\n', '""', "\n\nb", "é"]) for _ in range(rng.randrange(6)))
        name = "".join(rng.choice(["x", "y\nz", ", ", '""']) for _ in range(rng.randrange(1, 4)))
        # A short line or one with a hash in front would end the section, inside quotes too.
        note = "note " + note
        note, name = (t.replace("\n\n", "\n").replace("\n", "\nline ") for t in (note, name))
        lines.append(f'"{note}",2024-01-{k % 28 + 1:02d},"{name}",{k},"1x1,{k}x2"')
        expected.append((day(f"2024-01-{k % 28 + 1:02d}"), name.replace('""', '"'), float(k), ["1x1", f"{k}x2"]))
    return HEAD + "\n".join(lines), expected


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_cells_over_line_ends_in_small_splits(spark, tmp_path, limit, end):
    expected = []
    for seed in range(4):
        text, own = exported(seed, 60 * seed)
        (tmp_path / f"{seed}.csv").write_bytes((text + "\n#\n1,2").replace("\n", end).encode())
        expected += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = rows(read_csv_sections(spark, str(tmp_path), max_text_bytes=limit), "dt", "exercise", "rep_max", "sets")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted(expected, key=repr)


def test_texts_in_a_column(make):
    text, expected = exported(7, 50)
    found = parse_csv_sections(make([(1, text), (2, HEAD), (3, None)], "id int, text string"), ["id"], "text")
    assert rows(found, "dt", "exercise", "rep_max", "sets") == sorted(expected, key=repr)


def laid_out(make, body, columns):
    found = html_table(make([(1, f"<table>{body}</table>")], "id int, html string"), ["id"], "html", {c: c for c in columns})
    return [tuple(r) for r in found.select(*columns).collect()]


def test_spans(make):
    body = """<tr><th>a</th><th colspan="2">b</th><th rowspan=1>c</th><th>d</th></tr>
<tr><td rowspan=3>1</td><td>2</td><td rowspan="2" class=x>3</td><td colspan=2>4</td></tr>
<tr><td>5</td><td>6</td><td>7</td></tr>
<tr><td colspan='2' rowspan='2'>8</td><td>9</td><td>10</td></tr>
<tr><td>11</td><td>12</td></tr>"""
    assert laid_out(make, body, "abcd") == [("1", "2", "4", "4"), ("1", "5", "6", "7"), ("1", "8", "9", "10"), ("11", "8", "12", None)]


def test_spans_at_the_end_and_odd_values(make):
    body = "<tr><th>a<th>b<tr><td rowspan=3>x<td rowspan=0>y<tr><td colspan=abc>z"
    assert laid_out(make, body, "ab") == [("x", "y"), ("x", "z"), ("x", None)]
    assert laid_out(make, "<tr><th>a<th>b<tr><td>1<td>2", "ab") == [("1", "2")]
    assert laid_out(make, "<tr><th>a<th>b<tr><td colspan=99999>1", "ab") == [("1", "1")]


GYM_ROWS = [(day(f"{year}-03-01"), "squat", float(year), ["1x1"]) for year in (2019, 2020, 2021)]


def test_readers_keep_their_version(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    assert read_version(spark, path, GYM).count() == 0
    replace_version(make(GYM_ROWS, GYM), path, column="dt")
    first = read_version(spark, path, GYM)
    batch = make([*GYM_ROWS[2:], (day("2021-05-05"), "press", 1.0, None), (None, "row", 2.0, [])], GYM)
    merge_version(spark, path, batch, diagonal_merge, GYM)
    second = read_version(spark, path, GYM)
    replace_version(second.limit(1), path, column="dt")
    assert rows(first) == sorted(GYM_ROWS, key=repr)
    assert second.count() == 5 and read_version(spark, path, GYM).count() == 1
    with pytest.raises(ValueError, match="by years"):
        replace_version(second, path)
        merge_version(spark, path, batch, diagonal_merge, GYM)


def test_merge_touches_only_the_years_of_the_batch(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    replace_version(make(GYM_ROWS, GYM), path, column="dt")
    before = dict(versions.current_version(spark, path).folders)
    merge_version(spark, path, make([(day("2020-07-07"), "press", 1.0, [])], GYM), diagonal_merge, GYM)
    after = dict(versions.current_version(spark, path).folders)
    assert [y for y in before if before[y] != after[y]] == [2020]
    files = read_version(spark, path, GYM, years=[2020]).inputFiles()
    assert files and all("year=2020" in f for f in files)
    merge_version(spark, path, make([], GYM), diagonal_merge, GYM)
    assert dict(versions.current_version(spark, path).folders) == after


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["data", "count", "pointer", "half a pointer", "cleaning"])
def test_a_writer_can_break_off_anywhere(spark, make, tmp_path, monkeypatch, step):
    path = str(tmp_path / "gym")
    replace_version(make(GYM_ROWS, GYM), path, column="dt")
    batch = make([(day("2021-05-05"), "press", 1.0, [])], GYM)

    def fail(*_):
        raise Broken

    with monkeypatch.context() as patch:
        if step == "data":
            patch.setattr(versions, "_put", fail)
        elif step == "count":
            patch.setattr(versions, "_names", lambda *_: fail())
        elif step == "pointer":
            patch.setattr(versions, "_publish", fail)
        if step in ("data", "count", "pointer"):
            with pytest.raises(Broken):
                merge_version(spark, path, batch, diagonal_merge, GYM)
    if step == "half a pointer":
        (tmp_path / "gym" / "pointers" / f"{2:020d}").write_text('[[2021, "data/x/year=2021"]]\n12')
        (tmp_path / "gym" / "pointers" / f"{3:020d}").write_text("")
    if step == "cleaning":
        replace_version(make(GYM_ROWS, GYM), path, column="dt")
        (tmp_path / "gym" / "pointers" / f"{1:020d}").unlink()
    assert rows(read_version(spark, path, GYM)) == sorted(GYM_ROWS, key=repr)
    merge_version(spark, path, batch, diagonal_merge, GYM)
    merged = rows(read_version(spark, path, GYM))
    assert len(merged) == 4
    remove_old_versions(spark, path, keep=1, grace_seconds=0)
    assert rows(read_version(spark, path, GYM)) == merged
    listed = {folder.split("/")[1] for _, folder in versions.current_version(spark, path).folders}
    assert {p.name for p in (tmp_path / "gym" / "data").iterdir()} == listed


def test_old_versions_go_only_after_their_grace(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    for _ in range(4):
        replace_version(make(GYM_ROWS, GYM), path)
    assert remove_old_versions(spark, path, keep=1) == 0
    assert remove_old_versions(spark, path, keep=2, grace_seconds=0) == 2
    assert len(list((tmp_path / "gym" / "data").iterdir())) == 2 and read_version(spark, path, GYM).count() == 3


def test_two_writers(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    replace_version(make(GYM_ROWS, GYM), path)
    with pytest.raises(RuntimeError, match="another writer"):
        versions._publish(spark, path, 0, [])
    assert F is not None
