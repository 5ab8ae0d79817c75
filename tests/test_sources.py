"""Raw inputs, well-formed and not."""

import json
import zipfile

import pytest
from conftest import at, day, rows

from perioda.plans import ingest
from perioda.schemas import HEART_ZONE_SECONDS
from perioda.sources import (
    day_activities,
    day_pulse_samples,
    html_items,
    html_table,
    read_csv_sections,
    read_day_documents,
    read_gym_json,
    read_html_tables,
    read_metrics_xml,
    read_metrics_zip,
)
from perioda.sources import xml as xml_source

EXPORT = '''### PROFILE
name
### EXERCISE LOGS
------
row,mydate,ename,record,logs,extra
1,2024-01-01,"Curl, ""EZ""",45.5,"60x12,60x10",x
2,2024-01-02,Squat,,,
# end
3,2024-01-03,Late,1,1x1,x
'''
ROWS = [(day("2024-01-01"), 'Curl, "EZ"', 45.5, ["60x12", "60x10"]), (day("2024-01-02"), "Squat", None, None)]
FIELDS = ("dt", "exercise", "rep_max", "sets")

SECTIONS = {
    "plain": (EXPORT, ROWS),
    "windows": (EXPORT.replace("\n", "\r\n"), ROWS),
    "old_mac": (EXPORT.replace("\n", "\r"), ROWS),
    # The second carriage return is an empty line, which ends the section.
    "doubled_return": (EXPORT.replace(",x\n", ",x\r\r\n"), ROWS[:1]),
    "return_in_a_cell": (EXPORT.replace("2,2024-01-02,Squat,,,", "2,2024-01-02,Squat,,,\r3,2024-01-03,Row,1,1x1,"),
                         [*ROWS, (day("2024-01-03"), "Row", 1.0, ["1x1"])]),
    "long_cell": (EXPORT.replace(",x\n", ',"' + "y" * 100_000 + '"\n'), ROWS),
    "many_quotes": (EXPORT.replace(",x\n", ',"' + '""' * 20_000 + '"\n'), ROWS),
    "no_end": (EXPORT[: EXPORT.index("# end")].rstrip("\n"), ROWS),
    "short_line": (EXPORT.replace("# end", "-"), ROWS),
    "no_marker": (EXPORT.replace("EXERCISE LOGS", "SETS"), []),
    "only_heading": (EXPORT[: EXPORT.index("1,2024")], []),
    "end_at_once": (EXPORT.replace("row,mydate", "\nrow,mydate"), []),
    "marker_last": ("x\n### EXERCISE LOGS", []),
    "empty": ("", []),
    # The skipped line looks like an end, and another marker follows inside.
    "odd_skip": (EXPORT.replace("------", "#"), ROWS),
    "other_order": (
        "EXERCISE LOGS\n\nlogs,record,ename,mydate\n1x1,2,Press,2024-05-05\n\n",
        [(day("2024-05-05"), "Press", 2.0, ["1x1"])],
    ),
}


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("name", SECTIONS)
def test_sections(spark, tmp_path, name, limit):
    text, expected = SECTIONS[name]
    (tmp_path / "export.csv").write_bytes(text.encode())
    found = read_csv_sections(spark, str(tmp_path), max_text_bytes=limit)
    assert rows(found, *FIELDS) == sorted(expected, key=repr)


def test_sections_of_many_files_in_splits(spark, tmp_path):
    """Files cut into small splits give what whole files give."""
    expected = []
    for number in range(5):
        lines = [f"{i},2024-01-{i % 28 + 1:02d},E{number},{i}.5,{i}x1" for i in range(60 * (number + 1))]
        text = "junk\n" * number * 7 + "## EXERCISE LOGS\n--\nrow,mydate,ename,record,logs\n" + "\n".join(lines) + "\n\n7,x\n"
        (tmp_path / f"f{number}.csv").write_text(text)
        expected += [f"E{number}"] * len(lines)
    whole = read_csv_sections(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        cut = read_csv_sections(spark, str(tmp_path), max_text_bytes=3000)
        assert rows(cut) == rows(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.exercise for r in whole.orderBy("exercise").collect()] == sorted(expected)


def test_large_files_are_never_read_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "large.csv").write_text("x\n" * 5000)
    (tmp_path / "small.csv").write_text(EXPORT)
    whole = spark.read.text(str(tmp_path), wholetext=True).filter(F.col("_metadata.file_size") <= 1000)
    plan = whole.select(F.length("value"))._jdf.queryExecution().executedPlan()
    assert len(plan.executeCollect()) == 1
    scan = plan
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.metrics().get("filesSize").get().value() == len(EXPORT)


def test_section_without_a_column_fails(spark, tmp_path):
    (tmp_path / "e.csv").write_text(EXPORT.replace("record", "weight"))
    with pytest.raises(Exception, match="no column 'record'"):
        read_csv_sections(spark, str(tmp_path)).collect()


def test_bad_numbers_raise_or_become_null(spark, tmp_path):
    (tmp_path / "e.csv").write_text(EXPORT.replace("45.5", "heavy"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv_sections(spark, str(tmp_path)).collect()
    assert rows(read_csv_sections(spark, str(tmp_path), on_error="null"), "rep_max") == [(None,), (None,)]


def test_gym_json(spark, tmp_path):
    records = [
        {"date": "2017-10-03", "excercise": "Machine", "rep_max": "45", "sets": ["60x12", "60x12"]},
        {"date": "2017-10-15", "excercise": "Press", "rep_max": "81.67", "sets": []},
    ]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    found = rows(read_gym_json(spark, str(tmp_path)), "dt", "exercise", "sets")
    assert found == [(day("2017-10-15"), "Press", []), (day("2017-10-03"), "Machine", ["60x12", "60x12"])]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "l.json").write_text("\n".join(json.dumps(r) for r in records))
    assert rows(read_gym_json(spark, str(lines), multi_line=False), "dt", "exercise", "sets") == found
    (lines / "bad.json").write_text(json.dumps({**records[0], "date": "yesterday"}))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_gym_json(spark, str(lines), multi_line=False).collect()
    assert read_gym_json(spark, str(lines), multi_line=False, on_error="null").filter("dt is null").count() == 1


def documents(spark, tmp_path, *docs):
    (tmp_path / "days.json").write_text("\n".join(json.dumps(d) for d in docs))
    return read_day_documents(spark, str(tmp_path))


START_MS = 1740823200000  # 2025-03-01 10:00:00 UTC


def day_document(**changes):
    document = {
        "subjectId": 1,
        "birthYear": 1977,
        "ActivitiesForDay": {
            "payload": [
                {
                    "activityId": 5, "startTimeLocal": "2025-03-01T10:00:30.0", "distance": 5000.0, "duration": 170.0,
                    "activityType": {"typeKey": "running"}, "steps": 9, "zones": [{"zoneNumber": 2, "secsInZone": 7.5}],
                },
                {"activityId": 6, "startTimeLocal": "2025-03-01T12:00:00", "distance": 900.0, "duration": 60.0},
            ]
        },
        "AllDayHR": {
            "payload": {"heartRateValues": [[START_MS + s * 1000, hr] for s, hr in
                                            ((0, 100), (60, 110), (120, None), (180, 110), (240, 130))]}
        },
    }
    return {**document, **changes}


def test_day_documents(spark, tmp_path):
    df = documents(spark, tmp_path, day_document(), {"subjectId": 2, "AllDayHR": None}, {"subjectId": 3, "ActivitiesForDay": {}})
    assert rows(day_activities(df), "activity_id", "dt", "activity", "secs_zone1", "secs_zone2") == [
        (5, at("2025-03-01 10:00:30"), "running", None, 7.5), (6, at("2025-03-01 12:00:00"), None, None, None),
    ]
    assert rows(day_pulse_samples(df), "ts", "hr")[0] == (at("2025-03-01 10:00:00"), 100)
    assert rows(day_pulse_samples(df, "Europe/Stockholm"), "ts")[0] == (at("2025-03-01 11:00:00"),)


def test_import_of_days(spark, tmp_path):
    quiet = day_document(subjectId=2, AllDayHR={"payload": {"heartRateValues": None}})
    # The first document landed twice.
    df = documents(spark, tmp_path, day_document(), day_document(), quiet)
    fresh = ingest.ingest_activities(None, df).distinct()
    assert rows(fresh, "subject_id", "activity_id", *HEART_ZONE_SECONDS) == [
        (1, 5, 0, 0, 120, 0, 0, 0), (2, 5, None, None, None, None, None, None),
    ]
    merged = ingest.ingest_activities(fresh, df)
    assert rows(merged, "subject_id", "activity_id") == [(1, 5), (2, 5)]


RECORDS = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!ELEMENT Record ((MetadataEntry)*)>
<!ATTLIST Record type CDATA #REQUIRED>
]>
<HealthData locale="sv_SE">
 <Record type="HKQuantityTypeIdentifierBodyMass" unit="kg" startDate="2024-01-01 00:30:00 +0100" value="80.5"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="a &gt; b > c" unit="count"
   startDate="2024-01-02 23:59:59 +0100" value="12">
  <MetadataEntry key="HKQuantityTypeIdentifierBodyMass" value="1"/>
 </Record>
 <Record type="HKQuantityTypeIdentifierHeight" unit="cm" startDate="2024-01-01 00:30:00 +0100" value="180"/>
 <Record type='HKQuantityTypeIdentifierBodyFatPercentage' unit='%' startDate='2024-01-03 08:00:00 +0100' value='0.25'/>
 <RecordList type="HKQuantityTypeIdentifierBodyMass"/>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning"/>
</HealthData>
"""
METRICS = [
    (day("2024-01-01"), "bodymass", "kg", 80.5),
    (day("2024-01-02"), "stepcount", "count", 12.0),
    (day("2024-01-03"), "bodyfatpercentage", "%", 0.25),
]
COLUMNS = ("dt", "metric", "unit", "value")


def test_xml_records(spark, tmp_path):
    (tmp_path / "export.xml").write_text(RECORDS)
    assert rows(read_metrics_xml(spark, str(tmp_path)), *COLUMNS) == METRICS
    timed = read_metrics_xml(spark, str(tmp_path), keep_time=True)
    assert ("2024-01-01 00:30:00 +0100",) in rows(timed, "started")


def test_xml_without_a_root_loses_nothing(spark, tmp_path):
    line = '<Record type="HKQuantityTypeIdentifierBodyMass" unit="kg" startDate="2024-01-01 00:00:00 +0100" value="{}"/>\n'
    (tmp_path / "export.xml").write_text("".join(line.format(i) for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = read_metrics_xml(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert sorted(r.value for r in df.collect()) == [float(i) for i in range(1000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_record_fails(spark, tmp_path):
    (tmp_path / "export.xml").write_text(RECORDS.replace('value="80.5"', 'value="heavy"'))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_metrics_xml(spark, str(tmp_path)).collect()
    assert read_metrics_xml(spark, str(tmp_path), on_error="null").filter("value is null").count() == 1


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_zipped_export(spark, tmp_path, chunk, monkeypatch):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(xml_source.EXPORT_MEMBER, RECORDS)
            archive.writestr("apple_health_export/other.xml", RECORDS)
    found = read_metrics_zip(spark, str(tmp_path))
    assert rows(found, *COLUMNS) == sorted(METRICS * 2, key=repr)
    # The cut into pieces never falls inside a record.
    import io

    monkeypatch.setattr(xml_source, "_CHUNK_CHARS", chunk)
    pieces = list(xml_source._whole_records(io.StringIO(RECORDS)))
    tags = lambda text: xml_source._OPEN_TAG.findall(text)
    assert tags("".join(pieces)) == tags(RECORDS) == [tag for p in pieces for tag in tags(p)]


PAGE = """<html><table><tr><th>Datum</th></tr><tr><td>menu</td></tr></table>
<TABLE class="x"><tr><th>Datum</th><th> Kcal </th></tr>
<tr><td>2014-01-01</td><td><b>1,300</b></td></tr><tr><td>A &amp; B &lt;&nbsp;C</td></tr></TABLE> tail"""


def test_html_table(spark, make, tmp_path):
    columns = {"Kcal": "kcal", "Datum": "date"}
    pages = make([(1, PAGE), (2, "<p>no table</p>"), (3, "<table></table>")], "id int, html string")
    expected = [(1, "1,300", "2014-01-01"), (1, None, "A & B < C")]
    assert rows(html_table(pages, ["id"], "html", columns)) == sorted(expected, key=repr)
    with pytest.raises(Exception, match="no column 'Puls'"):
        html_table(pages, ["id"], "html", {"Puls": "p"}).collect()
    (tmp_path / "page.html").write_text(PAGE)
    assert read_html_tables(spark, str(tmp_path), columns).count() == 2


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_a_quote_that_stays_open_is_refused(spark, tmp_path, limit):
    (tmp_path / "export.txt").write_text(EXPORT.replace('"Curl, ""EZ"""', '"Curl'))
    with pytest.raises(Exception, match="not closed in its section"):
        read_csv_sections(spark, str(tmp_path), max_text_bytes=limit).collect()


def test_html_without_closing_tags_and_with_entities(make):
    page = """<TABLE><thead><tr><th>Str&auml;cka (km)<th>Datum<tbody>
<tr><td>1&#44;5 &#xE5;&aring;<!-- <td>no</td> --><td>2014-01-01
<tr><td>&nope; &#0; & &amp;lt; &lt;b&gt;<br>x</td>
<td> 2014&ndash;02&#8211;01 </td></tr></table>"""
    found = html_table(make([(1, page), (2, "<table class=x>" + page[7:-8])], "id int, html string"), ["id"], "html",
                       {"Sträcka (km)": "km", "Datum": "date"})
    expected = [("1,5 åå", "2014-01-01"), ("&nope; &#0; & &lt; <b>x", "2014–02–01")]
    assert rows(found, "km", "date") == sorted(expected * 2, key=repr)
    with pytest.raises(Exception, match="no row can be read"):
        html_table(make([(1, "<table><div>5 km</div></table>")], "id int, html string"), ["id"], "html", {"a": "a"}).collect()


def test_further_payload_fields_are_kept(spark, tmp_path):
    activity = {"activityId": 1, "startTimeLocal": "2024-01-01T10:00:00", "averageHR": 120, "device": {"name": "w"}}
    document = {"subjectId": 1, "ActivitiesForDay": {"payload": [activity]}}
    (tmp_path / "day.json").write_text(json.dumps(document))
    found = day_activities(read_day_documents(spark, str(tmp_path), fields="averageHR int, device struct<name: string>"))
    assert rows(found, "activity_id", "averageHR", "device.name") == [(1, 120, "w")]
    assert "averageHR" in ingest.flatten_days(
        read_day_documents(spark, str(tmp_path), fields="averageHR int")).columns


def test_a_long_start_tag_and_a_long_tail(spark, tmp_path):
    long_tag = RECORDS.replace("<Record ", "<Record " + "note='" + "n" * 50_000 + "' plain=" + "p" * 3000 + " ", 1).replace("plain=", 'plain="', 1)
    long_tag = long_tag.replace("p" * 3000, "p" * 3000 + '"', 1)
    (tmp_path / "export.xml").write_text(long_tag)
    assert rows(read_metrics_xml(spark, str(tmp_path)), *COLUMNS) == sorted(METRICS, key=repr)


def test_the_tail_behind_the_last_record_is_let_go(monkeypatch):
    import io
    import tracemalloc

    monkeypatch.setattr(xml_source, "_CHUNK_CHARS", 1 << 16)

    class Tail(io.TextIOBase):
        left = 400

        def read(self, size):
            self.left -= 1
            return '<Record type="a"/>' + "x" * size if self.left == 399 else "y" * size if self.left >= 0 else ""

    tracemalloc.start()
    pieces = list(xml_source._whole_records(Tail()))
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert "".join(pieces).startswith('<Record type="a"/>') and sum(map(len, pieces)) < 1 << 18


def test_html_items(make):
    page = '<ul><li><a href="/a">A</a></li><li class="x"> <a id="1" href="/b">B &amp; <i>c</i></a></li><li>no</li></ul>'
    assert rows(html_items(make([(1, page), (2, "")], "id int, html string"), ["id"], "html")) == [
        (1, 0, "/a", "A"), (1, 1, "/b", "B & c"),
    ]
