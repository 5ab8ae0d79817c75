"""Benchmark decontamination by n-grams of test items.

The items' windows become a sorted set of 64-bit hashes that every worker
gets.  Workers number the words of a document by the items' vocabulary, roll
a hash over the numbers, probe the set, and verify each hit word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, col, fresh, utf8
from perioda.session import written

WINDOW = 10
#: Text of test items that goes to the workers at once; more is done in blocks, a pass each.
MAX_BLOCK_BYTES = 4 << 20

#: Text that a worker scans at once, or one longer text.
GROUP_BYTES = 4 << 20

# On UTF-8 bytes: words are digits, letters and all that is not ASCII.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

SPANS = "struct<start: int, end: int>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN_TYPE)), ("items", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    """Words, with A-Z lower-cased and all else as it is."""
    return text.translate(_TO_WORDS).split()


@dataclass
class Windows:
    """Distinct windows of one length, sorted by hash, with the items each is in."""

    length: int
    hashes: np.ndarray
    numbers: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray
    longest_run: int


@dataclass
class ItemIndex:
    vocabulary: dict[bytes, int]
    names: list[str | None]
    windows: list[Windows]


def rolled(numbers: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` numbers, modulo 2**64."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values, total = numbers.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(length):
        total *= _FACTOR
        total += values[k : k + n]
    total ^= total >> np.uint64(29)
    return total


def index_items(rows: Sequence[tuple[str | None, bytes]], window: int) -> ItemIndex:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    names: list[str | None] = []
    for place, (name, text) in enumerate(rows):
        names.append(name)
        numbers = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in words_of(text)]
        length = min(window, len(numbers))
        for i in range(len(numbers) - length + 1) if length else ():
            by_length.setdefault(length, {}).setdefault(tuple(numbers[i : i + length]), set()).add(place)
    found = []
    for length, owners_of in sorted(by_length.items()):
        numbers = np.array(list(owners_of), np.int32).reshape(-1, length)
        hashes = np.concatenate([rolled(row, length) for row in numbers])
        order = np.argsort(hashes, kind="stable")
        values = list(owners_of.values())
        owners = [sorted(values[i]) for i in order]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        hashes = hashes[order]
        run = int(np.unique(hashes, return_counts=True)[1].max())
        found.append(Windows(length, hashes, numbers[order], starts, np.concatenate(owners).astype(np.int64), run))
    return ItemIndex(vocabulary, names, found)


def hits(index: ItemIndex, numbers: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(for each word whether it is hit, pairs of places and items).

    Number 0 is a word no item has, or the border between two documents; no
    window holds it.
    """
    edges, pairs = np.zeros(len(numbers) + 1, np.int32), []
    for w in index.windows:
        probes = rolled(numbers, w.length)
        first = np.searchsorted(w.hashes, probes)
        inside = np.flatnonzero(first < len(w.hashes))
        inside = inside[w.hashes[first[inside]] == probes[inside]]
        for k in range(w.longest_run):
            at = first[inside] + k
            near = inside[at < len(w.hashes)]
            at = first[near] + k
            same = np.ones(len(near), bool)
            for step in range(w.length):
                same &= numbers[near + step] == w.numbers[at, step]
            places, rows = near[same], at[same]
            np.add.at(edges, places, 1)
            np.add.at(edges, places + w.length, -1)
            many = w.owner_starts[rows + 1] - w.owner_starts[rows]
            begin = np.repeat(w.owner_starts[rows] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            pairs.append((np.repeat(places, many), w.owners[begin + np.arange(many.sum())]))
    return np.cumsum(edges[:-1]) > 0, pairs


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    found: list[list[int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [{"start": a, "end": b} for a, b in found]


def scan(index: ItemIndex, texts: list[bytes]) -> list[dict]:
    """n_words, spans of hit words and the items hit, for each text."""
    get, parts, bounds = index.vocabulary.get, [], [0]
    border = np.zeros(1, np.int32)
    for text in texts:
        words = words_of(text)
        parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), border]
        bounds.append(bounds[-1] + len(words) + 1)
    rows = [{"n_words": b - a - 1, "spans": [], "items": []} for a, b in zip(bounds, bounds[1:])]
    if not texts:
        return rows
    mask, pairs = hits(index, np.concatenate(parts))
    limits = np.array(bounds)
    jumps = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for start, end in jumps.reshape(-1, 2).tolist():
        at = int(np.searchsorted(limits, start, side="right")) - 1
        rows[at]["spans"].append({"start": start - bounds[at], "end": end - bounds[at]})
    owned: dict[int, set[int]] = {}
    for places, items in pairs:
        docs = np.searchsorted(limits, places, side="right") - 1
        if len(docs):
            for doc, item in np.unique(np.stack([docs, items], 1), axis=0).tolist():
                owned.setdefault(doc, set()).add(item)
    for doc, items in owned.items():
        rows[doc]["items"] = sorted({index.names[i] for i in items if index.names[i] is not None})
    return rows


def item_blocks(
    items: DataFrame, item_id: str, text: str, max_bytes: int
) -> Iterator[tuple[int, list[tuple[str | None, bytes]]]]:
    """(number of blocks, the items of one block), a block at a time and each of a checked size."""
    chosen = items.select(col(item_id).cast("string").alias("name"), utf8(text).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text") + 64).alias("bytes")).first()["bytes"] or 0
    n = max(1, math.ceil(total / max_bytes))
    for k in range(n):
        block = chosen
        if n > 1:
            block = chosen.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield n, [(row["name"], bytes(row["text"])) for row in block.distinct().collect()]


def _scan_column(df: DataFrame, block: list[tuple[str | None, bytes]], window: int, text: str) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(index_items(block, window))

    @arrow_function(f"n_words long, spans array<{SPANS}>, items array<string>")
    def scanned(texts: pa.Array) -> pa.Array:
        rows: list[dict] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text.as_py())
            size += len(group[-1])
            if size > GROUP_BYTES:
                rows += scan(shared.value, group)
                group, size = [], 0
        return pa.array(rows + scan(shared.value, group), _RESULT)

    return scanned(utf8(text))


def merge_spans(spans: Column) -> Column:
    """Sorted spans that neither overlap nor touch."""

    @arrow_function(f"array<{SPANS}>")
    def merged(rows: pa.Array) -> pa.Array:
        found = [_merged([(s["start"], s["end"]) for s in row or []]) for row in rows.to_pylist()]
        return pa.array(found, pa.list_(_SPAN_TYPE))

    return merged(spans)


def find_hits(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    out: str = "hits",
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans and items.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  Spans are word places [start, end) inside any occurrence of
    a window; items are the ids of the items with such windows, each once,
    sorted as strings.  A null text, of a document or an item, has no words.
    An item whose id is null hits words but is not listed.  Rows keep their
    number and columns; no items or no documents give no hits.

    The items are read in blocks of at most ``max_block_bytes`` of text.  With
    more than one block the documents are written between passes, so a worker
    holds one block at a time.
    """
    (state,) = fresh(docs.columns, out)
    (new,) = fresh([*docs.columns, state], "__new")
    scanned = None
    for n, block in item_blocks(items, item_id, item_text, max_block_bytes):
        if scanned is None:
            scanned = docs.withColumn(state, _scan_column(docs, block, window, text))
        else:
            later = scanned.withColumn(new, _scan_column(scanned, block, window, text))
            both = F.struct(
                col(new)["n_words"].alias("n_words"),
                merge_spans(F.concat(col(state)["spans"], col(new)["spans"])).alias("spans"),
                F.array_sort(F.array_union(col(state)["items"], col(new)["items"])).alias("items"),
            )
            scanned = later.withColumn(state, both).drop(new)
        if n > 1:
            scanned = written(scanned, "decontamination")
    return scanned


def n_hit(hits_column: Column) -> Column:
    """Number of words inside the spans."""
    lengths = F.transform(hits_column["spans"], lambda s: s["end"].cast("long") - s["start"].cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def cut_spans(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    pieces, last = [], 0
    for span in spans:
        start, end = places[span["start"]][0], places[span["end"] - 1][1]
        pieces.append(data[last:start])
        last = end
    return b"".join([*pieces, data[last:]]).decode()


def without_spans(text: Column, spans: Column) -> Column:
    @arrow_function("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), found.to_pylist())
        return pa.array([cut_spans(t, s) if t is not None and s else t for t, s in rows], pa.string())

    return cut(text, spans)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, remove: str = "documents", text: str = "text", **options
) -> DataFrame:
    """``docs`` without what the items' windows hit.

    ``remove`` is ``documents`` (rows with a hit go) or ``spans`` (they stay,
    without the hit words).  All other rows and columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown remove {remove!r}")
    (state,) = fresh(docs.columns, "__hits")
    found = find_hits(docs, items, text=text, out=state, **options)
    if remove == "documents":
        return found.filter(F.size(col(state)["spans"]) == 0).drop(state)
    return found.withColumn(text, without_spans(col(text), col(state)["spans"])).drop(state)


def report(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: words, hit words, items hit and their digest."""
    (state,) = fresh(docs.columns, "__hits")
    found = find_hits(docs, items, out=state, **options)
    items_hit = col(state)["items"]
    return found.select(
        col(doc_id).alias("doc_id"),
        col(state)["n_words"].alias("n_words"),
        n_hit(col(state)).alias("n_hit"),
        F.size(items_hit).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_hit), 256).alias("items_sha256"),
        (F.size(col(state)["spans"]) > 0).alias("contaminated"),
    )
