"""Arrays of records read in splits, against the parser of the standard library."""

import json
import random

import pytest
from conftest import rows

from perioda.sources import read_gym_json, read_json_array

SCHEMA = "id long, name string, deep struct<a: struct<b: string>, c: array<struct<d: long>>>"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "96", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def record(pick, number):
    letters = lambda: "".join(pick.choice('{}[]",\\\n å😀x') for _ in range(pick.choice([0, 3, 40, 200])))
    deep = {"a": {"b": letters()} if pick.random() < 0.7 else None, "c": [{"d": k} for k in range(pick.randrange(3))]}
    return {"id": number, "name": letters(), "deep": deep if pick.random() < 0.5 else None, "other": {"x": [{}, {"{": "}"}]}}


def plain(records):
    def of(r):
        deep = r["deep"]
        return r["id"], r["name"], deep and deep["a"] and deep["a"]["b"], deep and [c["d"] for c in deep["c"]]

    return sorted(map(of, records), key=repr)


def found(df):
    return rows(df.selectExpr("id", "name", "deep.a.b", "transform(deep.c, c -> c.d)"))


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 1), (3, None)])
def test_any_records_in_any_splits(spark, tmp_path, small_splits, seed, indent):
    pick, written = random.Random(seed), []
    for number in range(3):
        records = [record(pick, 100 * number + k) for k in range(pick.choice([1, 7, 30]))]
        (tmp_path / f"{number}.json").write_text(json.dumps(records, indent=indent, ensure_ascii=pick.random() < 0.5))
        written += records
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ]\n")
    assert found(read_json_array(spark, str(tmp_path), SCHEMA)) == plain(written)


def test_one_file_of_flat_records_is_read_by_several_tasks(spark, tmp_path, small_splits):
    records = [{"date": f"2017-10-{k:02}", "excercise": "Press \\\"", "rep_max": "4", "sets": [str(k), "b"]} for k in range(1, 29)]
    (tmp_path / "one.json").write_text(json.dumps(records, indent=2))
    df = read_gym_json(spark, str(tmp_path))
    assert rows(df.selectExpr("sets[0]", "exercise")) == sorted(((r["sets"][0], r["excercise"]) for r in records), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 10 and "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("text", ['{"id": 1}', '\n{"id": 1}\n', '{"id": 1}\n{"id": 2, "name": "}"}'])
def test_objects_without_an_array(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert rows(read_json_array(spark, str(tmp_path), SCHEMA), "id")[0] == (1,)


@pytest.mark.parametrize("text", [
    '[{"id": 1', '[{"id": 1}', '[{"id": 1},', '[{"id": 1}, {"id": 2', '{"id": 1', '{"id": 1, "name": "}', '[{"id": 1, "deep": {"a": {"b": "x"}}]',
    '[{"id": 1}, 7, {"id": 2}]', '[{"id": 1}}]', '[{"id": x}]', '[7]', '[{"id": 1}] x', '[{"id": "7}]',
])
def test_what_is_no_array_of_objects_raises(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_json_array(spark, str(tmp_path), SCHEMA).collect()
