"""The stage's classes against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline as cp
from perioda.llm import near_copies as nc


def brute(rows, threshold=0.8):
    def own(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [own(t) for _, t in rows], list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = {}
    for k, (i, _) in enumerate(rows):
        lowest[find(k)] = min(i, lowest.get(find(k), i))
    return sorted(lowest.values())


def edited(words, places, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_planted_copies(spark, make):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows += [edited(words, places, rng) for places in (0, 1, len(words) // 50, len(words) // 30, len(words) // 12)]
    # One large group, so loose that its buckets hold several classes.
    words = [f"v{k}" for k in range(200)]
    rows += [edited(words, rng.randrange(16), rng) for _ in range(300)]
    rows = list(enumerate([*rows, "", " \n", None, "short text", "Short  TEXT"]))
    rng.shuffle(rows)
    docs = make(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect())
    assert found == brute(rows)
    assert nc.keep_one(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == brute(rows)


def test_fingerprints_propose_near_copies(spark, make, monkeypatch):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [" ".join(words), " ".join(words[:-1]), " ".join(words).upper()]
    rows = [(i, t) for i, t in enumerate([*rows, "", None])]
    docs = make(rows, "doc_id long, text string")
    node, fp = nc.jaccard_join.sets("text", 5)["node"].alias("node"), nc.simhash.fingerprints("text", 5).alias("fp")
    nodes = docs.select("doc_id", node, fp)
    of = {r["node"]: r["doc_id"] // 3 for r in nodes.collect()}
    found = [(of[r["a"]], of[r["b"]]) for r in nc.simhash_pairs(nodes).collect()]
    assert len(found) > 30 and all(a == b for a, b in found)
    seen = []
    links = nc.simhash.links_between
    monkeypatch.setattr(nc.simhash, "links_between", lambda *a, **k: seen.append(1) or links(*a, **k))
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == brute(rows)
    assert seen
