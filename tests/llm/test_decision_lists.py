"""Counts against a plain version, and what is learned on held-out rows."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from perioda.llm import decision_lists as dl

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    hit = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#é", " ", "\n", "\t", "\x0b", "\xa0", " ", "\x1c", "|"]), max_size=80).map("".join))
def test_counts(text):
    assert dl.statistics_of(text)[:5] == brute(text)


def test_codes_stay_exact_with_many_words():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.permutation(30_000), np.arange(100), rng.permutation(9000), np.arange(100)])
    text = " ".join(f"w{i}" for i in words)
    assert dl.statistics_of(text)[4] == brute(text)[4] >= 200


def test_learns_a_conjunction():
    rng = np.random.default_rng(0)
    a, b = rng.random(6000), rng.random(6000)
    rules = dl.learn({"n_words": a, "mean_word": b}, (a > 0.7) & (b <= 0.4))
    a, b = rng.random(3000), rng.random(3000)
    said = np.logical_or.reduce([r.holds({"n_words": a, "mean_word": b}) for r in rules])
    truth = (a > 0.7) & (b <= 0.4)
    assert (said & truth).sum() > 0.85 * truth.sum() and (said & ~truth).sum() < 0.05 * said.sum()


@pytest.mark.parametrize("poor", [[], [True] * 9, [False] * 9])
def test_nothing_to_learn(poor):
    assert dl.learn({"n_words": np.arange(float(len(poor)))}, np.array(poor, bool)) == []


def test_held_out_precision(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rules = dl.fit(docs, labels.filter("doc_id % 2 = 0"))
    judged = dl.judge(docs, rules, out="q").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("q.kept", "quality")
    rows = [tuple(r) for r in judged.collect()]
    good = [kept for kept, quality in rows if quality == 1]
    poor = [kept for kept, quality in rows if quality == 0]
    assert sum(good) > 0.97 * len(good)
    assert sum(poor) < 0.5 * len(poor)


def test_rows_and_odd_texts(make):
    docs = make([(1, None, 0), (1, None, 0), (None, "", 1), (2, "a " * 40, 2), (3, " ".join(map(str, range(40))), 3)],
                "doc_id long, text string, __counts int")
    found = dl.judge(docs, [dl.Rule((dl.Condition("n_words", True, 1e9),))], out="q")
    assert found.columns == [*docs.columns, "q"]
    got = sorted((r["doc_id"], *r["q"]) for r in found.collect() if r["doc_id"])
    assert got == [(1, 0, 0, 0, 0, 0, True, False)] * 2 + [(2, 40, 40, 0, 0, 40, True, False), (3, 40, 70, 0, 0, 0, False, True)]
    assert dl.keep_good(docs, []).columns == docs.columns and dl.keep_good(docs, []).count() == 1
    assert dl.judge(docs.limit(0), []).count() == 0


def test_no_labels(make):
    docs = make([(1, "x")], "doc_id long, text string")
    assert dl.fit(docs, make([], "doc_id long, quality int")) == []
    assert dl.fit(docs, make([(None, 0), (1, None)], "doc_id long, quality int")) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: tuple(r["quality"])[:6] for r in dl.judge(docs, []).collect()}
    for r in docs.collect():
        own = brute(r["text"])
        assert found[r["doc_id"]] == (*own, own[0] < 10 or 100 * own[4] > 20 * own[0])


def plain_features(text):
    """FEATURES by their words, of texts without odd white space."""
    words, _, symbols, dup_lines, repeat = brute(text)
    own = re.findall("[^\x20\x09-\x0d]+", text)
    chars, lines = "".join(own), [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    share = lambda n, of: n / of if of else 0.0
    return {
        "n_words": float(words), "mean_word": share(len(chars), words), "symbol_share": share(symbols, words),
        "dup_line_share": share(dup_lines, len(lines)), "repeat_share": share(repeat, words),
        "words_per_line": share(words, len(lines)), "upper_share": share(len(re.findall("[A-Z]", text)), len(chars)),
        "digit_share": share(len(re.findall("[0-9]", text)), len(chars)),
        "mark_share": share(sum(text.count(c) for c in "!\"'(),-./:;?@[\\]^_`{}~+="), words),
        "distinct_share": share(len(set(own)), words), "twin_share": share(sum(a == b for a, b in zip(own, own[1:])), words),
    }


def test_kept_over_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rules = dl.fit(docs, labels)
    assert rules
    found = {r["doc_id"]: r["quality"] for r in dl.judge(docs, rules).collect()}
    rejected = 0
    for r in docs.collect():
        own, values = found[r["doc_id"]], plain_features(r["text"] or "")
        meets = any(
            all(values[c.feature] > c.threshold if c.above else values[c.feature] <= c.threshold for c in rule.conditions)
            for rule in rules
        )
        assert own["kept"] == (not own["base_failed"] and not meets)
        rejected += meets and not own["base_failed"]
    assert rejected and len(found) == docs.count()
