"""Levels, links and reply order of small mailboxes, and of all conversations."""

import random

import pytest
from pyspark.sql import functions as F

from perioda.llm import quotations as qt


@pytest.mark.parametrize("line, expected", [
    ("plain", (0, "plain")), ("> one", (1, "one")), (">> two", (2, "two")), ("> > two", (2, "two")), ("  >three", (1, "three")),
    ("a > b", (0, "a > b")), (">", (1, "")), ("", (0, "")),
])
def test_levels(line, expected):
    assert qt.level_of(line) == expected


def test_parse():
    own = qt.parse("Yes.\nOn Monday Ann wrote:\n> Is it so?\n>> It is not\n\nBye")
    assert own["own"] == "Yes.\nBye"
    assert {q["level"] for q in own["quotes"]} == {1, 2}
    assert qt.key_of("is  IT so?") in [q["key"] for q in own["quotes"]]
    assert qt.parse("") == {"own": "", "keys": [], "quotes": []} and qt.parse("> \n>")["quotes"] == []


MAILS = [
    ("l", 1, "Shall we meet on the hill at noon?\nBring some bread and a bit of cheese."),
    ("l", 2, "I can not come then.\n> Shall we meet on the  HILL at noon?\n> Bring some bread and a bit of cheese."),
    ("l", 3, "Only the bread is mine to bring.\nOn Tue Bo wrote:\n> Bring some bread and a bit of cheese."),
    ("l", 4, "Why ever not, my friend?\n> I can not come then.\n>> Shall we meet on the hill at noon?"),
    ("l", 5, "Nothing that I know is quoted.\n> words that nobody has ever sent here"),
    ("l", 6, "The middle one was lost.\n> a letter that was never delivered to us\n>> Why ever not, my friend?"),
    ("m", 7, "Another list.\n> I can not come then."),
    ("l", 8, "> quotes a later one"), ("l", 9, "quotes a later one"), ("l", 10, None), ("l", 11, ""), (None, 12, "no list at all"),
    (None, 13, "so be it\n> no list at all"), ("l", None, "no time is known for this"), ("l", 14, "late\n> no time is known for this"),
]


def test_links(make):
    found = qt.link(make([(*m, 1) for m in MAILS], "list string, sent long, body string, Root int"), scope=["list"], order="sent", text="body")
    assert found.columns == ["list", "sent", "body", "Root", "parent", "root_", "depth"]
    got = {r["sent"]: (r["parent"], r["root_"], r["depth"]) for r in found.collect()}
    assert got == {1: (None, 1, 0), 2: (1, 1, 1), 3: (1, 1, 1), 4: (2, 1, 2), 5: (None, 5, 0), 6: (4, 1, 3), 7: (None, 7, 0), 8: (None, 8, 0),
                   9: (None, 9, 0), 10: (None, 10, 0), 11: (None, 11, 0), 12: (None, 12, 0), 13: (12, 12, 1), None: (None, None, 0), 14: (None, None, 1)}
    texts = {r["sent"]: r["body"] for r in found.collect()}
    assert texts[2] == "I can not come then." and texts[10] is None and texts[11] == "" and texts[8] == ""


def test_copies_fare_alike_and_long_threads(make):
    mails = [(1, 0, "the very first message of the thread")]
    mails += [(1, i, f"reply number {i} to what was said\n> reply number {i - 1} to what was said") for i in range(2, 70)]
    mails.insert(1, (1, 1, "reply number 1 to what was said\n> the very first message of the thread"))
    found = qt.link(make(mails * 2, "box int, turn long, text string"), scope=["box"], order="turn").collect()
    assert len(found) == 140
    assert all((r["parent"], r["root"], r["depth"]) == (r["turn"] - 1 if r["turn"] else None, 0, r["turn"]) for r in found)


def test_empty(make):
    assert qt.link(make([], "turn long, text string"), order="turn").count() == 0


def test_all_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = qt.link(qt.with_quotes(turns), scope=["conv_id"], order="turn")
    assert found.count() == turns.count()
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in turns.collect()}
    key = lambda text: qt.key_of(" ".join(text.split("\n")))
    for r in found.collect():
        own = texts[r["conv_id"], r["turn"]]
        assert r["text"] == own.strip("\n")
        if r["turn"] and (r["conv_id"], r["turn"] - 1) in texts:
            before = texts[r["conv_id"], r["turn"] - 1]
            first = min(t for (c, t), own in texts.items() if c == r["conv_id"] and key(own) == key(before))
            assert r["parent"] == first
    assert found.filter(F.col("parent").isNotNull()).count() > 0


def test_root_and_depth_follow_the_parents_of_all_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = qt.link(qt.with_quotes(turns), scope=["conv_id"], order="turn").collect()
    parents = {(r["conv_id"], r["turn"]): r["parent"] for r in rows}
    assert len(parents) == len(rows)
    deepest = 0
    for r in rows:
        at, steps = r["turn"], 0
        while parents[r["conv_id"], at] is not None:
            assert parents[r["conv_id"], at] < at
            at, steps = parents[r["conv_id"], at], steps + 1
        assert (r["root"], r["depth"]) == (at, steps)
        deepest = max(deepest, steps)
    assert deepest > 1


@pytest.mark.parametrize("seed", range(3))
def test_roots_of_any_trees(make, seed):
    pick = random.Random(seed)
    # Chains of many lengths with leaves at their nodes, a star, and trees without a shape.
    up = {}
    for chain, length in enumerate([1, 2, 3, 7, 8, 9, 40]):
        up |= {f"{chain}-{k}": f"{chain}-{k - 1}" for k in range(1, length + 1)}
        up |= {f"{chain}-leaf-{k}": f"{chain}-{pick.randrange(length + 1)}" for k in range(12)}
    up |= {f"s-{k}": "s" for k in range(30)} | {f"t-{k}": f"t-{pick.randrange(k)}" for k in range(1, 200)}
    order = lambda node: None if node in ("s", "t-0") else len(node) * 1000 + hash(node) % 1000

    def of(node):
        root, depth = node, 0
        while root in up:
            root, depth = up[root], depth + 1
        return node, order(up[node]), root, order(root), depth

    parents = make([(node, parent, order(parent)) for node, parent in up.items()], "node string, parent string, o long")
    found = qt._roots(parents).select("node", "o", "root", "top", "depth")
    assert sorted(map(tuple, found.collect())) == sorted(map(of, up))
    assert qt._roots(parents.limit(0)).count() == 0
