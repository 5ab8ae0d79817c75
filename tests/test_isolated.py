"""A folder with files that cannot be read gives the others' rows and names the bad ones."""

import os

import pytest

from perioda.sources import isolated, read_readable

SCHEMA = "id long, v long"


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "a b")
    spark.range(100).selectExpr("id", "id * 2 AS v").repartition(4).write.parquet(path)
    return path


def whole(folder):
    return sorted(n for n in os.listdir(folder) if n.startswith("part-"))[0]


def put(folder, name, content):
    with open(f"{folder}/{name}", "wb") as file:
        file.write(content)


def test_bad_files_are_named_and_the_rest_is_read(spark, folder):
    with open(f"{folder}/{whole(folder)}", "rb") as file:
        content = file.read()
    put(folder, "cut.parquet", content[:-20])
    put(folder, "text.parquet", b"no table at all")
    put(folder, "tail.parquet", b"PAR1" + bytes(50) + b"PAR1")
    put(folder, "none.parquet", b"")
    put(folder, "_noted.parquet", b"hidden")
    rows, bad = read_readable(spark, folder, spark.range(0).selectExpr("id", "id AS v").schema)
    assert sorted(r["v"] for r in rows.collect()) == [2 * i for i in range(100)]
    assert rows.columns == ["id", "v"] and rows.filter("v = 6").count() == 1
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert set(found) == {"cut.parquet", "text.parquet", "tail.parquet"} and all(found.values())


def test_whole_files_without_rows_are_not_bad(spark, folder):
    spark.range(0).selectExpr("id", "id AS v").write.mode("append").parquet(folder)
    rows, bad = read_readable(spark, folder, spark.read.parquet(folder).schema)
    assert rows.count() == 100 and bad.count() == 0


def test_large_files_are_named_without_a_look(spark, folder, monkeypatch):
    put(folder, "cut.parquet", b"PAR1" + bytes(100))
    monkeypatch.setattr(isolated, "LOOK_INTO_BYTES", 50)
    _, bad = read_readable(spark, folder, spark.range(1).selectExpr("id", "id AS v").schema)
    assert [r["reason"] for r in bad.collect()] == ["no readable footer"]


def test_damage_behind_a_whole_footer_is_no_silent_loss(spark, folder):
    name = f"{folder}/{whole(folder)}"
    with open(name, "rb") as file:
        content = bytearray(file.read())
    content[4:120] = bytes(116)
    put(folder, whole(folder), bytes(content))
    os.remove(f"{folder}/.{whole(folder)}.crc")
    rows, bad = read_readable(spark, folder, spark.range(1).selectExpr("id", "id AS v").schema)
    assert bad.count() == 0
    with pytest.raises(Exception):
        rows.collect()
