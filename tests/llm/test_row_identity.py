"""Rows that differ only deep inside a value stay apart, and odd column names are harmless."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from perioda.llm import near_copies, pfair, quotations, sharding, simhash

TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here"


@pytest.fixture
def deep(spark, make):
    rows = [
        (1, TEXT, "a", [1], (None, 1), {"k": None}, 0.0), (1, TEXT, "a", [1, None], (1, None), {"k": None}, 0.0),
        (1, TEXT, "a", [None, 1], (1, None), {"k": None}, -0.0), (1, TEXT, "a", [None, 1], (1, None), {"k": 1}, 0.0),
        (1, TEXT, "a", [], (None, None), {}, float("nan")), (1, TEXT, "a", None, None, None, None),
    ]
    rows += rows[:2]
    return make(rows, "doc_id long, text string, source string, tags array<int>, pair struct<a: int, b: int>, map map<string, int>, x double")


def shown(df, columns):
    """Every value with its nulls and signs."""
    return Counter(tuple(map(repr, r)) for r in df.select(*columns).collect())


def test_no_row_is_lost(spark, deep):
    columns = deep.columns
    want = shown(deep, columns)
    assert len(want) == 6
    assert shown(sharding.shard_rows(deep, 3), columns) == want
    mixed = pfair.mix(deep).filter("epoch = 0")
    assert shown(mixed, columns) == want
    stages = dict(cp.STAGES)
    assert shown(stages["shards"](spark, stages["mixing"](spark, deep, ""), ""), columns) == want


def test_one_row_of_a_class_with_maps(deep):
    for keep_one in (simhash.keep_one, near_copies.keep_one):
        kept = keep_one(deep)
        assert kept.columns == deep.columns and kept.count() == 1


def test_names_that_the_code_uses(make):
    columns = ["n", "l", "f", "node", "label", "key", "id", "digest", "__maybe", "__map", "low", "of"]
    rows = [(1, TEXT, *range(12)), (2, TEXT, *range(12)), (None, "other words", *range(12)), (None, "other words", *range(12))]
    docs = make(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in columns))
    for keep_one in (simhash.keep_one, near_copies.keep_one):
        found = keep_one(docs)
        assert found.columns == docs.columns and sorted((r["doc_id"] for r in found.collect()), key=repr) == [1, None]


def test_mails_with_names_that_the_code_uses(make):
    turns = make([(1, 1, "a", 0, 0), (1, 2, "b", 0, 0), (1, 3, "c", 0, 0)], "conv_id int, turn int, text string, __s1 int, __t1 int")
    found = quotations.with_quotes(turns).orderBy("turn").collect()
    assert [r["text"] for r in found] == ["a", "b\n> a", "c\n> b\n>> a"]


def test_bit_map(spark, make):
    rows = make([(k, f"t{k}") for k in range(3000)], "doc_id long, text string").withColumn("d", F.unhex(F.md5("text")))
    gone = rows.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.col("d").alias("digest"))
    bits = near_copies.PAGE * 4
    marked = near_copies.with_bit(rows, near_copies.bit_map(gone, bits), bits, doc_id="doc_id", text="text", out="bit").collect()
    assert all(r["bit"] for r in marked if r["doc_id"] % 10 == 0)
    assert sum(r["bit"] for r in marked if r["doc_id"] % 10) < 30
