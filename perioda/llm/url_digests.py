"""URL rules as a sorted digest array.

The rules' keys are hashed to 64 bits and sorted; the array is memory-mapped
and probed for all candidate keys of a batch by one binary search.  A match of
digests counts only if the stored key is the same string.  Rules beyond the
size of one array are probed in blocks, an array and a pass each.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perioda.llm.common import arrow_function, col, fresh
from perioda.session import new_shared_path, remove, written

ALLOW, BLOCK = "allow", "block"
#: Size of an array, keys and digests; more rules than fit in one are probed block by block.
MAX_ARRAY_BYTES = 32 << 20
#: Between host and path; a rule that holds it itself is void.
_BAR = "\x00"

# In the order in which rules of several blocks win.
_JUDGED = pa.struct([("size", pa.int32()), ("host_size", pa.int32()), ("rule", pa.string()), ("blocked", pa.bool_())])


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _clean(rules: DataFrame) -> DataFrame:
    """One row per key; where verdicts differ, block holds."""
    known = rules.filter("host is not null and host <> '' and path is not null and verdict is not null")
    known = known.filter(~F.contains(F.concat("host", "path"), F.lit(_BAR)))
    key = F.concat("host", F.lit(_BAR), "path")
    grouped = known.groupBy("host", "path").agg(F.max(F.col("verdict") == BLOCK).alias("blocked"))
    return grouped.select(key.alias("key"), "host", "path", "blocked")


class DigestArray:
    """Sorted digests, the keys behind them and their verdicts, in one mapped file."""

    def __init__(self, image: bytes):
        self.file = tempfile.TemporaryFile()  # has no name, so it goes with the worker
        self.file.write(image)
        self.file.flush()
        self.map = np.memmap(self.file, np.uint8, "r")
        n, hosts, paths = self.map[:24].view(np.uint64).tolist()
        cut = np.cumsum([24, 8 * n, 8 * (n + 1), 8 * hosts, 8 * paths, n]).tolist()
        self.digests = self.map[cut[0] : cut[1]].view(np.uint64)
        self.starts = self.map[cut[1] : cut[2]].view(np.uint64)
        self.host_lengths = self.map[cut[2] : cut[3]].view(np.uint64).tolist()
        self.path_lengths = self.map[cut[3] : cut[4]].view(np.uint64).tolist()
        self.blocked = self.map[cut[4] : cut[5]]
        self.keys = self.map[cut[5] :]

    @staticmethod
    def image(rows: Sequence[tuple[str, bool]]) -> bytes:
        keyed = sorted((xxhash.xxh64_intdigest(key.encode(), 42), key.encode(), blocked) for key, blocked in rows)
        lengths = [sorted({len(key.split(_BAR)[part]) for key, _ in rows}) for part in (0, 1)]
        head = np.array([len(keyed), *map(len, lengths)], np.uint64)
        digests = np.array([d for d, _, _ in keyed], np.uint64)
        starts = np.cumsum([0, *(len(k) for _, k, _ in keyed)]).astype(np.uint64)
        blocked = np.array([b for _, _, b in keyed], np.uint8)
        parts = [head, digests, starts, *(np.array(x, np.uint64) for x in lengths), blocked]
        return b"".join([*(part.tobytes() for part in parts), *(k for _, k, _ in keyed)])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of each key, or -1."""
        probes = np.fromiter((xxhash.xxh64_intdigest(key, 42) for key in keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, probes)
        found = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero((first < len(self.digests)) & (len(self.digests) > 0)).tolist():
            at = int(first[i])
            while at < len(self.digests) and self.digests[at] == probes[i]:
                if self.keys[int(self.starts[at]) : int(self.starts[at + 1])].tobytes() == keys[i]:
                    found[i] = at
                    break
                at += 1
        return found


def candidates(host: str, path: str, host_lengths: Sequence[int], path_lengths: Sequence[int]) -> list[str]:
    """The keys that could fit: host or a parent of it, and a start of the path; best first."""
    hosts = [host[-n:] for n in host_lengths if n == len(host) or (n < len(host) and host[-n - 1] == ".")]
    pairs = [(h, path[:n]) for h in hosts for n in path_lengths if n <= len(path)]
    pairs.sort(key=lambda p: (-len(p[0]) - len(p[1]), -len(p[0])))
    return [h + _BAR + p for h, p in pairs]


_OPEN: dict[str, DigestArray] = {}


def judge_batch(array: DigestArray, hosts: list[str], paths: list[str]) -> list[dict]:
    keys, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        own = candidates(host, path, array.host_lengths, array.path_lengths)
        keys += own
        owner += [i] * len(own)
    rows: list[dict] = [dict.fromkeys(_JUDGED.names) for _ in hosts]
    found = array.find([key.encode() for key in keys])
    for j in np.flatnonzero(found >= 0).tolist():
        if rows[owner[j]]["rule"] is None:
            rule, size = keys[j].replace(_BAR, ""), keys[j].index(_BAR)
            rows[owner[j]] = {"size": len(rule), "host_size": size, "rule": rule, "blocked": bool(array.blocked[found[j]])}
    return rows


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    otherwise: str = ALLOW,
    max_array_bytes: int = MAX_ARRAY_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule (host, path, verdict) fits a url on its host or any subdomain whose
    path starts with the rule's.  The longest rule string wins, then the
    longer host; of one rule with both verdicts, block.  Without a rule the
    verdict is ``otherwise``.  A null url, or one without ``://``, has an
    empty host and path and no rule.  Rules with an empty or null host, a null
    path or verdict, or a null character are void.  Rows and columns stay; a column that has
    one of the new names keeps it, and the new one gets an underscore.

    ``max_array_bytes`` bounds the array that a worker and the driver hold.
    Rules beyond it are cut into blocks by a hash of their keys, half that
    size on average; each block is one pass over the distinct hosts and paths,
    whose best rule so far is written in between.
    """
    host, path, rule, verdict = fresh(pages.columns, "host", "path", "rule", "verdict")
    (state,) = fresh([*pages.columns, host, path, rule, verdict], "__judged")
    parts = pages.withColumns({host: host_of(col(url)), path: path_of(col(url))})
    known = _clean(rules)
    total = known.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    if total <= max_array_bytes:
        rows = known.select("key", "blocked").collect()
        judged = parts.withColumn(state, _by_array(pages.sparkSession, rows)(col(host), col(path)))
    else:
        judged = _in_blocks(parts, known, host, path, state, -(-2 * total // max(1, max_array_bytes)))
    return judged.select(
        *map(col, pages.columns),
        col(host),
        col(path),
        col(state)["rule"].alias(rule),
        F.when(col(state)["blocked"].isNull(), otherwise)
        .when(col(state)["blocked"], BLOCK)
        .otherwise(ALLOW)
        .alias(verdict),
    )


def _by_array(spark: SparkSession, rows: Sequence, shared: list | None = None) -> Callable[[Column, Column], Column]:
    """The best of ``rows`` for a host and path; the broadcast is put in ``shared`` if it is one of several."""
    image = DigestArray.image([(row["key"], row["blocked"]) for row in rows])
    sent, key, alone = spark.sparkContext.broadcast(image), xxhash.xxh128_hexdigest(image), shared is None
    if not alone:
        shared.append(sent)

    @arrow_function("size int, host_size int, rule string, blocked boolean")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        if key not in _OPEN:
            if not alone:
                _OPEN.clear()
            _OPEN[key] = DigestArray(sent.value)
        return pa.array(judge_batch(_OPEN[key], hosts.to_pylist(), paths.to_pylist()), _JUDGED)

    return judged


def _in_blocks(parts: DataFrame, known: DataFrame, host: str, path: str, state: str, blocks: int) -> DataFrame:
    """``parts`` with the best rule of all blocks."""
    spark = parts.sparkSession
    known = written(known.select("key", "blocked"), "url-rules")
    blocks = max(1, min(blocks, known.count()))
    h, p = fresh([*parts.columns, state], "__h", "__p")
    none = F.lit(None).cast("struct<size: int, host_size: int, rule: string, blocked: boolean>")
    best = parts.select(col(host).alias(h), col(path).alias(p)).distinct().withColumn(state, none)
    earlier = None
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()
        if not rows and block + 1 < blocks:
            continue
        shared: list = []
        found = _by_array(spark, rows, shared)(col(h), col(p))
        place = new_shared_path(spark, "url-verdicts")
        best.withColumn(state, F.greatest(col(state), found)).write.parquet(place)
        best = spark.read.schema(best.schema).parquet(place)
        shared[0].destroy()
        if earlier:
            remove(spark, earlier)
        earlier = place
    joined = parts.join(best, (col(host) == col(h)) & (col(path) == col(p)), "left")
    return joined.drop(h, p)
