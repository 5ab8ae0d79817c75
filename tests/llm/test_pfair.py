"""Deviation at every slot, and that no row is lost."""

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from perioda.llm import pfair


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcdef", max_size=3), st.floats(0.001, 1000), min_size=1, max_size=12))
def test_every_slot_is_within_a_block_of_the_target(weights):
    whole = pfair.whole_weights(weights, 500)
    assert sum(whole.values()) == 500 and min(whole.values()) >= 1
    placed = Counter()
    for slot, (name, block) in enumerate(pfair.schedule(whole)):
        assert block == placed[name]
        assert block * 500 // whole[name] <= slot < -(-(block + 1) * 500 // whole[name])
        placed[name] += 1
        for other, w in whole.items():
            assert abs(placed[other] - w * (slot + 1) / 500) < 1
    assert placed == whole


def test_weights_are_near_what_was_asked():
    whole = pfair.whole_weights({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, 10_000)
    assert whole == {"a": 5000, "b": 3000, "c": 2000} or all(abs(whole[n] - w) <= 2 for n, w in (("a", 5000), ("b", 3000), ("c", 2000)))
    with pytest.raises(ValueError):
        pfair.whole_weights(dict.fromkeys("abc", 1.0), 2)


ROWS = ([(i, "hot", 0) for i in range(700)] + [(i, "warm", 0) for i in range(200)] + [(i, "rare", 0) for i in range(9)]
        + [(1, None, 0)] * 70 + [(None, "warm", 1)] * 5)


def check(rows, weights_of, block_rows):
    """Deviation over whole blocks, and the order inside."""
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r["slot"], []).append(r)
    assert sorted(by_slot) == list(range(len(by_slot)))
    placed, total = Counter(), sum(weights_of.values())
    for slot in range(len(by_slot)):
        (source,) = {r["source"] for r in by_slot[slot]}
        assert len({(r["source_block"], r["epoch"]) for r in by_slot[slot]}) == 1
        assert sorted(r["place"] for r in by_slot[slot]) == list(range(len(by_slot[slot]))) and len(by_slot[slot]) <= block_rows
        placed[source] += 1
        for name, w in weights_of.items():
            assert abs(placed[name] - w * (slot + 1) / total) < 1


@pytest.mark.parametrize("bucket_rows", [4_096, 50])
def test_mix(make, bucket_rows):
    docs = make(ROWS, "doc_id long, source string, slot int").drop("slot")
    weights = {"hot": 2.0, "warm": 1.0, "rare": 0.5, None: 0.5, "absent": 3.0}
    found = pfair.mix(docs, weights, block_rows=8, bucket_rows=bucket_rows, period=400).collect()
    check(found, {"hot": 2, "warm": 1, "rare": 0.5, None: 0.5}, 8)
    first = Counter((r["doc_id"], r["source"]) for r in found if r["epoch"] == 0)
    assert first == Counter((i, s) for i, s, _ in ROWS)
    again = Counter(r["source"] for r in found)
    assert again["rare"] > 5 * 9  # starts again until the others are through


def test_default_weights_unlisted_sources_and_names(make):
    docs = make(ROWS, "doc_id long, source string, slot int")
    found = pfair.mix(docs, block_rows=16)
    assert found.columns == ["doc_id", "source", "slot", "source_block", "epoch", "slot_", "place"]
    assert {r["source"] for r in found.collect()} == {"hot", "warm", "rare", None}
    only = pfair.mix(docs.drop("slot"), {"warm": 1.0}, block_rows=16)
    assert only.count() == 205
    assert pfair.mix(docs.limit(0)).count() == 0


def test_laid_out_in_order(make):
    docs = make(ROWS, "doc_id long, source string, slot int").drop("slot")
    laid = [(r["slot"], r["place"]) for r in pfair.ordered(pfair.mix(docs, block_rows=8)).collect()]
    assert laid == sorted(laid)


def test_more_sources_than_slots(make):
    docs = make([(i, f"s{i}") for i in range(30)], "doc_id long, source string")
    with pytest.raises(ValueError):
        pfair.mix(docs, period=20)
    assert pfair.mix(docs, period=30).filter("epoch = 0").count() == 30


def test_exact_shares_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source")
    counts = Counter(r["source"] for r in docs.collect())
    found = pfair.mix(docs, seed=42, block_rows=4).collect()
    check(found, pfair.chosen_weights(counts, None, None), 4)
    first = Counter((r["doc_id"], r["source"]) for r in found if r["epoch"] == 0)
    assert first == Counter((r["doc_id"], r["source"]) for r in docs.collect())
    # Blocks of a source come in turn, and again from the first one.
    for source, n in counts.items():
        turns = sorted({(r["slot"], r["epoch"], r["source_block"]) for r in found if r["source"] == source})
        blocks = -(-n // 4)
        assert [(e, b) for _, e, b in turns] == [(k // blocks, k % blocks) for k in range(len(turns))]
