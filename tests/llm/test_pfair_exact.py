"""Shares over more slots than any fixed period, and any number of sources."""

from collections import Counter

from perioda.llm import pfair


def test_small_shares_are_not_rounded_up_over_a_long_mix():
    counts = {"large": 1_000_000, **{f"s{i:03}": 200 for i in range(300)}}
    weights = pfair.chosen_weights(counts, {n: float(c) for n, c in counts.items()}, None)
    names, total, placed = list(weights), sum(weights.values()), Counter()
    blocks = [-(-counts[n] // 64) for n in names]
    slots = list(pfair.slots_until([weights[n] for n in names], blocks))
    assert len(slots) > 10_000
    for slot, (k, turn) in enumerate(slots):
        assert turn == placed[k]
        placed[k] += 1
        for other in (0, k, 300) if slot % 500 else range(301):
            assert abs(placed[other] - weights[names[other]] * (slot + 1) / total) < 1
    assert all(placed[k] >= b for k, b in enumerate(blocks))


def test_mix_longer_than_10_000_slots(spark):
    # A block a row: 30,000 slots.
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN 'one' ELSE 'large' END AS source")
    found = pfair.mix(docs, {"large": 29_999.0, "one": 1.0}, block_rows=1)
    assert Counter(r["source"] for r in found.select("source").collect()) == {"large": 29_999, "one": 1}


def test_more_than_10_000_sources(spark):
    docs = spark.range(10_050).selectExpr("id AS doc_id", "CAST(id AS string) AS source")
    assert pfair.mix(docs).count() == 10_050
