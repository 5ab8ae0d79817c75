"""Every row has one place, shards are even, and the order is random and repeatable."""

import zlib
from collections import Counter

import pytest

from perioda.llm import sharding

ROWS = [(i, f"text {i % 7}", i % 3) for i in range(500)] + [(7, "same", 1)] * 300 + [(None, None, None)] * 3 + [(9, "", 0), (8, "é" * 9000, 0)]


@pytest.fixture
def docs(make):
    return make(ROWS, "doc_id long, text string, slot int")


def places(found, shard="shard", slot="slot"):
    taken = {}
    for r in found:
        taken.setdefault(r[shard], []).append(r[slot])
    return taken


@pytest.mark.parametrize("bucket_rows", [40, 16_384])
def test_assign(docs, bucket_rows):
    found = sharding.assign(docs, 16, seed=3, bucket_rows=bucket_rows).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    taken = places(found)
    assert set(taken) == set(range(16))
    sizes = [len(slots) for slots in taken.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in taken.values())


def test_same_seed_same_order(docs):
    runs = [sorted(map(tuple, sharding.assign(docs, 4, seed=s, bucket_rows=50).collect()), key=repr) for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]


def test_order_is_random(make):
    """Ids spread evenly over slots: no shard or part of one prefers small ids."""
    rows = make([(i, "x") for i in range(4000)], "doc_id long, text string")
    found = sharding.assign(rows, 4, bucket_rows=300).collect()
    for shard in range(4):
        own = [r["doc_id"] for r in found if r["shard"] == shard]
        assert abs(sum(own) / len(own) - 2000) < 150
    first = [r["doc_id"] for r in found if r["slot"] < 250]
    assert abs(sum(first) / len(first) - 2000) < 150


def test_whole_rows_keep_their_columns(docs):
    found = sharding.shard_rows(docs, 3, bucket_rows=64)
    assert found.columns == ["doc_id", "text", "slot", "shard", "slot_"]
    rows = found.collect()
    assert Counter((r["doc_id"], r["text"], r["slot"]) for r in rows) == Counter(ROWS)
    assert all(sorted(s) == list(range(len(s))) for s in places(rows, slot="slot_").values())


def test_empty_and_fewer_rows_than_shards(docs):
    assert sharding.assign(docs.limit(0), 16).count() == 0
    few = sharding.assign(docs.filter("doc_id = 9 and text = ''"), 16).collect()
    assert [(r["shard"], r["slot"]) for r in few] == [(0, 0)]


def test_written_in_order(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    sharded = sharding.shard_rows(docs.drop("slot"), 4)
    sharding.write_shards(sharded, path, files=2)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS)
    for r in back.groupBy("shard").count().collect():
        assert r["count"] in (len(ROWS) // 4, len(ROWS) // 4 + 1)


def test_no_python_in_the_plan(docs):
    plan = sharding.assign(docs, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
