"""Hits against a plain search, and what is removed."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from perioda.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window):
    """(n_words, hit places, item names) by comparing every window with every place."""
    rows = []
    for text in texts:
        own, hit, names = words(text), set(), set()
        for name, item in items:
            theirs = words(item)
            m = min(window, len(theirs))
            for i in range(len(theirs) - m + 1) if m else ():
                for j in range(len(own) - m + 1):
                    if own[j : j + m] == theirs[i : i + m]:
                        hit |= set(range(j, j + m))
                        names.add(name)
        rows.append((len(own), hit, sorted(n for n in names if n is not None)))
    return rows


def spread(spans):
    return {p for s in spans for p in range(s["start"], s["end"])}


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("a b c É 1 Ab".split()), max_size=25).map(" ".join), max_size=5),
    st.lists(st.lists(st.sampled_from("a b c É 1 Ab x".split()), max_size=8).map(" ".join), max_size=4),
)
def test_scan_is_the_plain_search(texts, items):
    named = [(str(i), item) for i, item in enumerate(items)]
    index = dc.index_items([(n, t.encode()) for n, t in named], 4)
    found = dc.scan(index, [t.encode() for t in texts])
    assert [(r["n_words"], spread(r["spans"]), r["items"]) for r in found] == brute(texts, named, 4)


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "rolled", lambda numbers, length: (numbers[: max(0, len(numbers) - length + 1)] * 0).astype("u8"))
    index = dc.index_items([("1", b"a b c"), ("2", b"c b a"), ("3", b"a b c")], 3)
    found = dc.scan(index, [b"x a b c y", b"c b a", b"b b b"])
    assert [r["items"] for r in found] == [["1", "3"], ["2"], []]


DOCS = [
    (1, "X one, TWO three! y", "k"), (1, "X one, TWO three! y", "k"), (2, None, None), (None, "", "k"), (3, "one two", "k"),
    (4, "short", None), (5, "word " * 3000 + "one two three", "k"),
]
ITEMS = [(10, "One two three"), (9, "two three"), (None, "SHORT"), (8, None), (7, "--"), (10, "One two three")]


@pytest.fixture
def tables(make):
    return make(DOCS, "doc_id long, text string, hits string"), make(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 70])
def test_report(tables, block):
    docs, items = tables
    found = dc.report(docs, items, window=3, max_block_bytes=block)
    digest = lambda *names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        (1, 5, 3, 2, digest("10", "9"), True), (1, 5, 3, 2, digest("10", "9"), True), (2, 0, 0, 0, digest(), False),
        (None, 0, 0, 0, digest(), False), (3, 2, 0, 0, digest(), False), (4, 1, 1, 0, digest(), True),
        (5, 3003, 3, 2, digest("10", "9"), True)], key=repr)


def test_removal(tables):
    docs, items = tables
    kept = dc.decontaminate(docs, items, window=3)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [2, 3, None]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, remove="spans", window=3).collect()}
    assert cut[1] == "X ! y" and cut[2] is None and cut[None] == "" and cut[3] == "one two" and cut[4] == ""


def test_empty_tables(tables):
    docs, items = tables
    assert dc.report(docs.limit(0), items).count() == 0
    assert dc.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    texts = docs.collect()
    expected = brute([r["text"] for r in texts], [(str(r["item_id"]), r["text"]) for r in items.collect()], 10)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in dc.report(docs, items).collect()}
    assert found == {r["doc_id"]: (n, len(hit), len(names)) for r, (n, hit, names) in zip(texts, expected)}
    assert any(hit for _, hit, _ in expected)
