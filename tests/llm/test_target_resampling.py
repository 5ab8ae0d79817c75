"""Weights, scores and ranks against a plain version, and brackets that the sketch gets wrong."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from perioda.llm import target_resampling as tr


def features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    every, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(every + buckets) / ((s[b] + 1) * float(wanted + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        n, own = features(text, longest)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = fit[: percent * len(fit) // 100]
    rest = Counter(rows) - Counter(drawn)
    return Counter((*(r[0], *r[2:]), k) for k, r in enumerate(drawn, 1)) + Counter({(r[0], *r[2:], None): n for r, n in rest.items()})


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    return docs, target, [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()]


@pytest.mark.parametrize("options", [{}, {"accuracy": 2, "task_rows": 7}, {"max_words": 2, "percent": 37, "min_words": 3}])
def test_whole_table(tables, options):
    docs, target, rows, items = tables
    plain = {"longest": options.get("max_words", 1), "percent": options.get("percent", 10), "least": options.get("min_words", 20)}
    assert found(tr.resample(docs, target, **options)) == brute(rows, items, **plain)


def test_odd_rows(make):
    words = " ".join(f"Wort{k}" for k in range(30))
    rows = [(None, words), (None, words), (1, words + " né"), (1, words + " né"), (1, words), (2, None), (3, ""), (4, "x" * 50_000), (5, words * 40)]
    rows += [(k, f"{words} {k}") for k in range(6, 30)]
    docs = make([(*r, 1, "s") for r in rows], "doc_id long, text string, score int, rank string")
    target = make([(None,), ("wort1 wort2",), ("",)], "text string")
    for percent in (0, 10, 50, 100):
        got = found(tr.resample(docs, target, percent=percent, accuracy=3, task_rows=4))
        assert got == brute(rows, ["wort1 wort2"], percent=percent)
    assert tr.resample(docs.limit(0), target).count() == 0
    assert found(tr.resample(docs, target.limit(0), percent=50)) == brute(rows, [], percent=50)
