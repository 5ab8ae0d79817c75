"""Keys, links and classes against all pairs of a small table."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from perioda.llm import golay, simhash as sh
from perioda.llm.components import component_labels


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def brute_classes(nodes, distance=2):
    """node -> smallest node of its class, comparing all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aB", "É", "x", " ", "\n", "\xa0", "longer"]), max_size=60).map(" ".join))
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == brute_print(text)


def test_golay_words_at_distance_one_share_an_index():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = golay.nearby_indices(words)
    for bit in range(23):
        other = golay.nearby_indices(words ^ (1 << bit))
        assert (near[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.integers(0, 63), st.integers(0, 63))
def test_two_bits_leave_a_key_in_common(value, i, j):
    other = value ^ (1 << i)
    other = other ^ (1 << j) if i != j else other
    keys = sh.golay_keys(np.array([signed(value), signed(other)], np.int64))
    assert set(keys[0].tolist()) & set(keys[1].tolist())


def planted():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist()
    prints = set(centres) | {0, (1 << 64) - 1, 1 << 63}
    for k, c in enumerate(centres):
        for _ in range(k):
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                c ^= 1 << b
            prints.add(c)
    dense = centres[0]
    prints |= {dense ^ (1 << i) ^ (1 << j) for i in range(18) for j in range(i)}
    return [signed(p) for p in prints]


@pytest.mark.parametrize("bucket", [256, 2, 10])
@pytest.mark.parametrize("distance", [2, 1, 0])
def test_links_join_what_all_pairs_join(spark, make, bucket, distance):
    prints = planted()
    links = sh.links_between(make([(p,) for p in prints], "fp long"), distance, bucket)
    rows = [(r["a"], r["b"]) for r in links.collect()]
    assert all(0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance for a, b in rows)
    labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
    expected = brute_classes(prints, distance)
    linked = {n for pair in rows for n in pair}
    assert {n: labels.get(n, n) for n in prints} == expected
    assert set(labels) == linked


def test_components_of_a_long_chain(make):
    rng = np.random.default_rng(2)
    order = rng.permutation(400).tolist()
    links = make(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002), (7, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in component_labels(links).collect()}
    assert labels == {**dict.fromkeys(range(400), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}
    assert component_labels(links.limit(0)).count() == 0


TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here"
DOCS = [(5, TEXT, 1), (3, TEXT.upper(), 2), (3, TEXT.upper(), 2), (9, "other words entirely in this one text", 3), (8, None, 4),
        (2, " \n", 5), (None, TEXT, 6), (None, "alone with no id at all in this row", 7), (7, "w " * 30000, 8)]


def test_classes_and_what_stays(make):
    docs = make(DOCS, "doc_id long, text string, __class int")
    found = sh.classes(docs).withColumn("hex", sh.hex_digits("fingerprint"))
    got = sorted(((r["doc_id"], r["hex"], r["component_id"]) for r in found.collect()), key=repr)
    of = {5: 3, 3: 3, 9: 9, 8: 2, 2: 2, 7: 7}
    expected = [(i, f"{brute_print(t):016x}", of[i] if i is not None else 3 if t == TEXT else None) for i, t, _ in DOCS]
    assert got == sorted(expected, key=repr)
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 3, 7, 9, None]
    assert sh.classes(docs.limit(0)).count() == 0 and sh.keep_one(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    prints = {r["doc_id"]: signed(brute_print(r["text"])) for r in rows}
    classes = brute_classes(sorted(set(prints.values())))
    lowest = {}
    for doc, p in prints.items():
        lowest[classes[p]] = min(doc, lowest.get(classes[p], doc))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in sh.classes(docs).collect()}
    assert found == {doc: (p, lowest[classes[p]]) for doc, p in prints.items()}
