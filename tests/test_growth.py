"""What keeps the queries' steps in proportion to their input."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from checks import catalog
from conftest import rows
from perioda.session import shared_dir
from perioda.sources import html_table, json_arrays, sections
from test_plans import plan_of

FOLDER = "/root/testdata/sf0.001"


def folders(spark, label):
    root = shared_dir(spark).removeprefix("file:")
    return {os.path.join(root, name) for name in os.listdir(root) if name.startswith(f"{label}-")}


@pytest.mark.parametrize("name, label", [("src_html_table", "pages"), ("src_csv_section_lines", "gym-exports"), ("src_json_gym_array", "gym-arrays")])
def test_no_folder_for_each_file(spark, name, label):
    before = folders(spark, label)
    catalog.QUERIES[name](spark, FOLDER)
    (new,) = folders(spark, label) - before
    assert os.listdir(new) and not any(entry.is_dir() for entry in os.scandir(new))


def test_a_long_table_under_one_span(make):
    """Text that ends cells, in every form, between cells that reach down and right."""
    body = "<tr><th>a<th>b<th>c<tr><td rowspan=99>x" + "".join(f"<td>{i}</TH ><td colspan=1>\n&amp;<b> {i}\xa0 \n!</b></td ></tr>junk<tr>" for i in range(50))
    found = html_table(make([(1, f"<table>{body}</table>")], "id int, html string"), ["id"], "html", {c: c for c in "abc"})
    expected = [("x", str(i), f"& {i} !") for i in range(50)] + [("x", None, None)] * 49
    assert [tuple(r) for r in found.select("a", "b", "c").collect()] == expected


def test_archives_are_packed_record_by_record(spark):
    assert "collect_list" not in plan_of(catalog._packed_exports(spark, FOLDER, 3))


def test_arrivals_are_written_by_all_tasks(spark, monkeypatch):
    seen, coalesce = [], DataFrame.coalesce
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: seen.append(self.columns) or coalesce(self, n))
    assert catalog.stream_hr_secs(spark, FOLDER).count() > 0
    assert not any({"sample_id", "activity_id"} & set(columns) for columns in seen)


def test_first_places_of_a_section_need_no_sort_of_the_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("### EXERCISE LOGS\n-----\nmydate,ename,record,logs\n2020-01-01,x,1,1x1\n\n")
    lines = spark.read.text(str(tmp_path)).select(
        F.col("_metadata.file_path").alias("source"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.col("value").alias("line"),
    )
    section = sections._section_of_lines(lines, True)
    assert rows(section, "line") == [("2020-01-01,x,1,1x1",)]
    # The lines of a split go through a hash; one row a split is left to sort.
    assert "HashAggregate" in plan_of(sections._firsts(lines, "of", "first"))


def test_array_splits_are_dealt_by_size(spark, tmp_path, monkeypatch):
    text = "[" + ",\n".join(f'{{"a": {i}, "b": {{"c": "}}"}}}}' for i in range(3000)) + "]"
    (tmp_path / "one.json").write_text(text)
    monkeypatch.setattr(json_arrays, "_TASK_BYTES", 2000)
    seen, dealt = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *c: seen.append(n) or dealt(self, n, *c))
    found = json_arrays.read_json_array(spark, str(tmp_path), "a long, b struct<c: string>")
    assert rows(found.select("a", "b.c")) == sorted([(i, "}") for i in range(3000)], key=repr)
    assert max(seen) >= len(text) // 2000
