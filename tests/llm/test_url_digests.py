"""Verdicts against a plain search over all rules, by one array and in blocks."""

import re

import pytest

from perioda.llm import url_digests as ud
from perioda.llm.queries import URL_RULES

URLS = [
    "https://m.a.example.org/en/123", "https://example.org/es/", "http://EXAMPLE.org/es", "http://org/x?y", "http://borg/x",
    "https://b.com/fr/1?u=://q", "https://b.com/de/", "com/de/", None, "", "://", "http://x.com", "x://y://com/fr/", "http://.com/fr/",
    "http://a.com:80/fr/", "HTTP://Sub.Example.ORG/en/1#top", "http://" + "a." * 20000 + "org/" + "p" * 20000, "http://É.org/é\n/x",
    "https://example.org/en/1", "https://example.org/en/1",
]


def brute(url, rules):
    found = re.match("(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), found[2]) if found else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p) for h, p, v in rules
            if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


RULES = [*URL_RULES, ("b.com", "/de/", "allow"), ("b.com", "/de/", "block"), ("", "/", "block"), (None, "/", "block"), ("x.com", None, "block")]


@pytest.mark.parametrize("limit", [1 << 20, 0, 300])
def test_verdicts(spark, make, limit):
    pages = make([(i, u, "c") for i, u in enumerate(URLS)], "page_id long, url string, Host string")
    rules = make(RULES, "host string, path string, verdict string")
    found = ud.judge_urls(pages, rules, max_array_bytes=limit)
    assert found.columns == ["page_id", "url", "Host", "host_", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(URLS)}
    assert ud.judge_urls(pages.limit(0), rules, max_array_bytes=limit).count() == 0
    none = ud.judge_urls(pages, rules.limit(0), otherwise="block", max_array_bytes=limit)
    assert none.filter("verdict = 'block' and rule is null").count() == len(URLS)


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(ud.xxhash, "xxh64_intdigest", lambda *_: 7)
    array = ud.DigestArray(ud.DigestArray.image([("a\x00/", True), ("b\x00/", False)]))
    assert [array.keys is not None, *(array.blocked[i] for i in array.find([b"a\x00/", b"b\x00/"]))] == [True, 1, 0]
    assert array.find([b"c\x00/"]).tolist() == [-1]


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = ud.judge_urls(pages, ud.rules_table(spark, URL_RULES))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {r["page_id"]: brute(r["url"], URL_RULES) for r in pages.collect()}


def test_the_longest_rule_wins_over_blocks(spark, make):
    rules = [(f"{'a.' * (k % 3)}b.com", "/" + "x" * (k // 3), "block" if k % 2 else "allow") for k in range(60)]
    # Equally long with another split between host and path.
    rules += [("com", "/xx/yy", "allow"), ("b.com", "/xx/y", "block")]
    urls = [f"http://{'a.' * (k % 4)}b.com/{'x' * (k % 25)}{'/yy' * (k % 2)}" for k in range(200)]
    pages = make(list(enumerate(urls)), "page_id long, url string")
    table = make(rules, "host string, path string, verdict string")
    found = ud.judge_urls(pages, table, max_array_bytes=1000)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
