"""Counts of every order against filters applied one after the other."""

import itertools
import re
from collections import Counter, defaultdict

from perioda.llm import filter_audit as fa

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, labels):
    said = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        said[i] = [max(said[i][0], quality == 1), max(said[i][1], toxic == 1)]
    lowest = {}
    big = float("inf")
    for i, text, _ in docs:
        lowest[text or ""] = min(lowest.get(text or "", big), big if i is None else i)
    rows = defaultdict(list)
    for i, text, part in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if lowest[text] < (big if i is None else i):
            fails.add("E")
        rows[part or ""].append((fails, *(said[i] if i is not None else [0, 0])))
    found, shapley = {}, Counter()
    for part, own in rows.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                out, stay = [r for r in left if name in r[0]], [r for r in left if name not in r[0]]
                gone = sum(name in r[0] for r in own) - len(out)
                alone = sum(r[0] == {name} for r in own)
                found[part, order, step] = [len(stay), len(out), gone, alone, sum(r[1] for r in out), sum(r[2] for r in out)]
                shapley[part, name] += len(out)
                left = stay
    return {key: (*values, shapley[key[0], key[1][key[2] - 1]]) for key, values in found.items()}


def rows_of(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


def test_odd_rows(make):
    many = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, many, "en"), (2, many, "de"), (2, many, "en"), (3, many, "en"), (None, many, None), (None, "only here", None),
        (4, None, "en"), (5, "", ""), (6, "ABC", "en"), (7, "a # b", "en"), (8, "same " * 200, "fr"), (9, "é" * 50 + " A" * 5, "fr"),
        (9, many + " \x0b" + many, "en"), (10, "x\x1cy z " * 150, "en"), (10, "x\x1cy z " * 150, "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    table = make([(*r, r[2], 1) for r in docs], "doc_id long, text string, lang string, part string, mask int")
    said = make([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, id int")
    found = rows_of(fa.audit(table, said))
    assert found == brute(docs, labels) and len(found) == 4 * 600
    assert fa.audit(table.limit(0), said).count() == 0
    assert rows_of(fa.audit(table, said.limit(0))) == brute(docs, [])


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    own = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert rows_of(fa.audit(docs, labels)) == brute(own, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
