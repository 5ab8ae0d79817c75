"""Merging a batch into existing rows."""

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from perioda.operators import align_merge, diagonal_merge, merge_keep_existing, stack
from perioda.plans import ingest
from perioda.schemas import GYM, METRICS
from perioda.sources import load_or_empty, merge_into_table, read_table, replace_table
from perioda.sources import tables
from perioda.streaming import stream_into_table


@pytest.fixture
def sides(make):
    old = make([(1, "a", 1), (2, None, 2), (2, None, 2)], "k int, n string, x int")
    new = make([(1, "a", 9), (2, None, 3), (3, "c", 4)], "k int, n string, y int")
    return old, new


def test_align(sides):
    expected = [(1, "a", 1, 9), (2, None, 2, None), (2, None, None, 3), (3, "c", None, 4)]
    assert rows(align_merge(*sides), "k", "n", "x", "y") == sorted(expected, key=repr)


def test_align_equals_a_full_outer_join(make):
    old = make([(1, i % 3) for i in range(50)] + [(2, 1), (None, 5), (4, None)], "k int, x int")
    new = make([(1, i % 4) for i in range(50)] + [(3, 1), (None, 6), (None, None)], "k int, y int")
    expected = old.join(new, "k", "full").distinct()
    assert rows(align_merge(old, new), "k", "x", "y") == rows(expected, "k", "x", "y")


def test_align_of_equal_columns_and_repetition(make):
    old = make([(1, "a"), (1, "a"), (None, "b")], "k int, n string")
    new = make([("c", 2), ("a", 1)], "n string, k int")
    merged = align_merge(old, new)
    assert rows(merged, "k", "n") == [(1, "a"), (2, "c"), (None, "b")]
    assert rows(align_merge(merged, new), "k", "n") == rows(merged, "k", "n")
    assert rows(align_merge(new, old), "k", "n") == rows(merged, "k", "n")


def test_diagonal(sides):
    assert diagonal_merge(*sides).count() == 5


def test_types_must_match(make):
    with pytest.raises(ValueError, match="types differ"):
        diagonal_merge(make([(1,)], "k int"), make([("1",)], "k string"))
    with pytest.raises(ValueError, match="columns differ"):
        stack(make([(1,)], "k int"), make([(1,)], "j int"))


def test_existing_rows_win(make):
    schema = "k int, n string, sets string"
    old, new = make([(1, None, "A")], schema), make([(1, None, "B"), (2, "x", "C"), (2, "x", "D")], schema)
    kept = merge_keep_existing(old, new, ["k", "n"], [F.col("sets")])
    assert rows(kept) == [(1, None, "A"), (2, "x", "C")]


GYM_ROWS = [(day("2023-05-01"), "squat", 50.0, ["60x12"]), (day("2024-05-01"), "squat", 55.0, ["60x12", "50x1"])]


def test_gym_imports(make):
    old = make(GYM_ROWS[:1], GYM)
    again = make([(GYM_ROWS[0][0], "squat", 50.0, ["other"]), GYM_ROWS[1]], GYM)
    assert ingest.ingest_gym_json(old, again).count() == 3
    assert rows(ingest.ingest_gym_csv(old, again), "rep_max", "sets") == [(50.0, ["60x12"]), (55.0, ["60x12", "50x1"])]


def test_metrics_of_one_day_collapse(make):
    same = [(1, day("2024-01-01"), "stepcount", "count", 5.0)] * 2
    assert ingest.ingest_metrics(make(same[:1], METRICS), make(same, METRICS)).count() == 1


def test_missing_table_is_empty(spark, tmp_path):
    df = load_or_empty(spark, str(tmp_path / "none"), GYM)
    assert df.count() == 0 and df.schema == GYM
    (tmp_path / "bad").write_text("not a table")
    with pytest.raises(Exception):
        load_or_empty(spark, str(tmp_path / "bad"), GYM).collect()


def test_replace_a_table_by_itself(spark, make, tmp_path):
    path = str(tmp_path / "t")
    replace_table(make(GYM_ROWS * 2, GYM), path)
    replace_table(read_table(spark, path, GYM).distinct(), path)
    assert read_table(spark, path, GYM).count() == 2


class Lost(Exception):
    pass


def breaks_at(patch, step):
    """Let a replace or merge break off before its ``step``-th rename, or (0) before the marker is set."""
    moves, real = [], tables._move

    def move(files, source, target):
        moves.append(target)
        if len(moves) == step:
            raise Lost
        real(files, source, target)

    patch.setattr(tables, "_move", move)
    if step == 0:
        def unfinished(df, path, partition_by, marker):
            df.limit(1).write.partitionBy(*partition_by).parquet(tables._beside(path, "staging"))
            raise Lost
        patch.setattr(tables, "_stage", unfinished)


def left_beside(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir() if "__" in p.name)


@pytest.mark.parametrize("step", [0, 1, 2])
def test_a_replace_can_break_off_anywhere(spark, make, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    replace_table(make(GYM_ROWS[:1], GYM), path)
    with monkeypatch.context() as patch, pytest.raises(Lost):
        breaks_at(patch, step)
        replace_table(make(GYM_ROWS, GYM), path)
    tables.finish_swap(spark, path)
    assert read_table(spark, path, GYM).count() == (1 if step == 0 else 2)
    replace_table(read_table(spark, path, GYM).union(make(GYM_ROWS, GYM)).distinct(), path)
    assert read_table(spark, path, GYM).count() == 2 and left_beside(tmp_path) == []


MERGED = [(day("2023-05-01"), 50.0), (day("2024-05-01"), 55.0), (day("2024-06-01"), 60.0), (day("2025-01-01"), 61.0)]


@pytest.mark.parametrize("step", range(7))
def test_a_merge_can_break_off_anywhere(spark, make, tmp_path, monkeypatch, step):
    path = str(tmp_path / "gym")
    merge_into_table(spark, path, make(GYM_ROWS, GYM), diagonal_merge, GYM)
    batch = make([GYM_ROWS[0], (day("2024-06-01"), "squat", 60.0, []), (day("2025-01-01"), "squat", 61.0, [])], GYM)
    with monkeypatch.context() as patch:
        breaks_at(patch, step)
        try:
            merge_into_table(spark, path, batch, diagonal_merge, GYM)
        except Lost:
            pass
        else:
            assert step == 6  # three years: two renames for those that were there, one for the new one
    for _ in range(2):
        merge_into_table(spark, path, batch, diagonal_merge, GYM)
        assert rows(read_table(spark, path, GYM), "dt", "rep_max") == sorted(MERGED, key=repr)
    assert left_beside(tmp_path) == []


def test_an_empty_batch_changes_nothing(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    merge_into_table(spark, path, make([], GYM), diagonal_merge, GYM)
    assert load_or_empty(spark, path, GYM).count() == 0
    merge_into_table(spark, path, make(GYM_ROWS, GYM), diagonal_merge, GYM)
    merge_into_table(spark, path, make([], GYM), diagonal_merge, GYM)
    assert read_table(spark, path, GYM).count() == 2


def test_a_stream_that_broke_off_is_taken_up(spark, make, tmp_path, monkeypatch):
    arrivals, path, log = (str(tmp_path / name) for name in ("in", "table", "log"))
    start = lambda: stream_into_table(
        spark.readStream.schema(GYM).parquet(arrivals), path, diagonal_merge, GYM, log
    ).awaitTermination()
    make(GYM_ROWS, GYM).write.parquet(arrivals)
    start()
    make([(day("2024-06-01"), "squat", 60.0, [])], GYM).write.mode("append").parquet(arrivals)
    with monkeypatch.context() as patch, pytest.raises(Exception, match="Lost"):
        breaks_at(patch, 2)
        start()
    start()
    assert rows(read_table(spark, path, GYM), "dt", "rep_max") == sorted(MERGED[:3], key=repr)


def test_the_batch_is_evaluated_once(spark, make, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    batch = make(GYM_ROWS, GYM).repartition(1).mapInPandas(seen, GYM)
    merge_into_table(spark, str(tmp_path / "gym"), batch, diagonal_merge, GYM)
    assert counted.value == len(GYM_ROWS)


def test_merge_rewrites_only_the_years_of_the_batch(spark, make, tmp_path):
    path = str(tmp_path / "gym")
    merge_into_table(spark, path, make(GYM_ROWS + [(None, "squat", 1.0, [])], GYM), diagonal_merge, GYM)
    files = lambda year: sorted(p.name for p in (tmp_path / "gym" / f"year={year}").glob("*.parquet"))
    before = files(2023), files(2024)
    batch = make([GYM_ROWS[1], (day("2024-06-01"), "squat", 60.0, [])], GYM)
    for _ in range(2):
        merge_into_table(spark, path, batch, diagonal_merge, GYM)
    assert files(2023) == before[0] and files(2024) != before[1]
    assert rows(read_table(spark, path, GYM), "dt", "rep_max") == sorted(
        [(day("2023-05-01"), 50.0), (day("2024-05-01"), 55.0), (day("2024-06-01"), 60.0), (None, 1.0)], key=repr
    )


def test_stream_equals_batch(spark, make, tmp_path):
    arrivals, path, log = (str(tmp_path / name) for name in ("in", "table", "log"))
    batches = [GYM_ROWS, [GYM_ROWS[1], (day("2024-06-01"), "squat", 60.0, ["1x1"])]]
    for batch in batches:
        make(batch, GYM).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(GYM).parquet(arrivals)
        stream_into_table(stream, path, diagonal_merge, GYM, log).awaitTermination()
    expected = diagonal_merge(make(batches[0], GYM), make(batches[1], GYM))
    assert rows(read_table(spark, path, GYM)) == rows(expected)
