"""Which passages go, against plain versions with and without the chunks, and that cuts move with the text."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from perioda.llm import line_chunks as lc

PLAIN = lc.Cutting()


def cut(docs, ranges_of):
    """doc -> text without all ranges that stand before, and the lines gone; docs are (id, text) by id."""
    seen, found = set(), []
    places = [(i, a, b) for i, (_, text) in enumerate(docs) for a, b in ranges_of((text or "").split("\n"))]
    gone = defaultdict(set)
    for i, a, b in sorted(places):
        piece = "\n".join(docs[i][1].split("\n")[a:b])
        if piece in seen:
            gone[i] |= set(range(a, b))
        seen.add(piece)
    for i, (name, text) in enumerate(docs):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        found.append((name, kept, len(gone[i])))
    return found, gone


def brute(docs):
    return cut(docs, lambda lines: lc.chunks([x.encode() for x in lines], PLAIN))[0]


def every_two(lines):
    """Every two lines in a row with words, and every long line: all that a repeated passage can be made of."""
    own = [i for i, x in enumerate(lines) if x.encode().split()]
    return [(a, b + 1) for a, b in zip(own, own[1:])] + [(i, i + 1) for i in own if len(lines[i].encode().split()) >= 50]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bb", b"", b" ", b"c d", b"w " * 50]), max_size=30))
def test_chunks_hold_words_and_reach_every_line(lines):
    found = lc.chunks(lines, PLAIN)
    own = [i for i, x in enumerate(lines) if x.strip()]
    for a, b in found:
        assert a in own and b - 1 in own
        assert b - a == 1 and len(lines[a].split()) >= 50 or 2 <= sum(bool(x.strip()) for x in lines[a:b]) <= 8
    if len(own) > 1:
        assert {k for a, b in found for k in range(a, b)} >= set(own)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 9), st.integers(0, 9), st.integers(2, 30))
def test_chunks_move_with_the_text(before, behind, n):
    passage = [f"line {i} of the passage".encode() for i in range(n)]
    rows = [f"other {i}".encode() for i in range(before)] + passage + [f"end {i}".encode() for i in range(behind)]
    inside = {(a - before, b - before) for a, b in lc.chunks(rows, PLAIN) if before <= a and b <= before + n}
    # Only the two chunks that the ends of the bare text cut off may differ.
    assert len(set(lc.chunks(passage, PLAIN)) ^ inside) <= 14
    assert inside <= set(lc.chunks(passage, PLAIN))


@pytest.mark.parametrize("lines, words", [(2, 30), (2, 26), (3, 18), (4, 15), (6, 12), (8, 10), (10, 6), (20, 10), (1, 51)])
def test_recall_of_planted_passages(lines, words):
    """20 documents hold each of 50 passages in fresh surroundings; the plain version cuts them all."""
    rng = random.Random(lines * 100 + words)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs, whole, copies = [], 0, 0
    passages = [[fresh(words) for _ in range(lines)] for _ in range(50)]
    for _ in range(20):
        for passage in passages:
            rows = [fresh(8) for _ in range(rng.randrange(5))] + passage + [fresh(8) for _ in range(rng.randrange(5))]
            docs.append((len(docs), "\n".join(rows)))
    found, _ = cut(docs, lambda rows: lc.chunks([x.encode() for x in rows], PLAIN))
    plain, _ = cut(docs, every_two)
    for (_, _, n), (_, _, most) in zip(found[50:], plain[50:]):
        assert most == lines and n <= most
        whole, copies = whole + (n == most), copies + 1
    assert whole >= 0.9 * copies


def test_borders_must_lie_in_their_chunk():
    with pytest.raises(ValueError):
        lc.Cutting(window=3, min_lines=2)


def test_a_shared_passage_goes_from_all_but_one(make):
    passage = "\n".join(f"shared line {i} here" for i in range(40))
    docs = [(i, f"own {i} start\nmore {i}\n{passage}\nown {i} end") for i in range(12)]
    found = {r["doc_id"]: r for r in lc.remove_repeated(make(docs, "doc_id long, text string")).collect()}
    assert found[0]["removed_lines"] == 0 and found[0]["text"] == docs[0][1]
    for i in range(1, 12):
        assert found[i]["removed_lines"] > 30
        assert f"own {i} start\nmore {i}" in found[i]["text"] and found[i]["text"].endswith(f"own {i} end")


ROWS = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, None), (4, ""), (5, "\n\n\n"), (6, "w " * 60), (7, "x\n" + "w " * 60 + "\ny"),
        (8, "p q\n" * 3000), (9, "é\r\nü\nä"), (10, "é\r\nü\nä")]


@pytest.mark.parametrize("copies", [1, 3])
def test_rows(make, copies):
    docs = make([(i, t, "k") for i, t in ROWS] * copies, "doc_id long, text string, removed_lines string")
    found = lc.remove_repeated(docs)
    assert found.columns == ["doc_id", "text", "removed_lines", "removed_lines_"]
    got = sorted(((r["doc_id"], r["text"], r["removed_lines_"]) for r in found.collect()), key=repr)
    assert got == sorted(brute(ROWS) * copies, key=repr)


def test_null_ids_and_empty_table(make):
    docs = make([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc\nz")], "doc_id long, text string")
    found = {(r["doc_id"], r["text"]) for r in lc.remove_repeated(docs).collect()}
    assert (None, "a\nb\nc") in found and len(found) == 3
    assert lc.remove_repeated(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = sorted((r["doc_id"], r["text"], r["removed_lines"]) for r in lc.remove_repeated(docs).collect())
    assert found == brute(rows) and any(gone for _, _, gone in found)
    plain, _ = cut(rows, every_two)
    assert all(own[2] <= most[2] for own, most in zip(found, plain))
    assert sum(own[2] for own in found) >= 0.9 * sum(most[2] for most in plain)
