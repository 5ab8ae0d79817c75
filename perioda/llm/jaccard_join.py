"""Jaccard join of shingle sets by prefixes of token combinations.

Tokens (shingles) are ordered by the number of distinct sets that hold them.
In a set x, a partner misses fewer tokens than ``need(x)``; so a prefix of x
whose tokens can't all be spoiled by that many misses holds something that the
partner's prefix holds too.  Rare tokens are indexed one by one.  Frequent
ones say little alone, so they are indexed in combinations of two, very
frequent ones of three: c tokens of a class that are combined by k survive
c - k misses with a combination left, which is why prefixes are extended
until these margins add up to ``need``.

Tokens of one set only take no index entry, but fill the prefix; most sets
have enough of them and are done.  What shares an index entry is clustered,
and inside a cluster pairs are held against an upper bound of their overlap
(parity bits) and then verified on their tokens.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, col, ship_package, utf8
from perioda.llm.components import component_labels
from perioda.session import written

SHINGLE_WORDS = 4
#: Least similarity, in hundredths.
PERCENT = 85
SEED = 42
#: Tokens in up to PAIRS sets are indexed alone, in up to TRIPLES in twos, beyond in threes.
PAIRS, TRIPLES = 32, 1024
#: Sets of fewer tokens are indexed by single tokens throughout.
COMBINED_FROM = 32
#: Tokens that a task sorts at a time, and bytes of text for each part of the token space.
FLUSH_TOKENS, PART_BYTES = 2_000_000, 12 << 20
MAX_TASKS = 8192
#: Clusters up to this size are compared at once, in blocks of sets; of larger ones the members of an index entry.
CLUSTER, BLOCK = 4096, 2048
#: Closest pairs of two classes that are verified first.
CLOSEST = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """Hashes of words, remembered; emptied when it has too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_WORDS = _WordHashes()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _FACTORS[3]
    return values ^ (values >> np.uint64(32))


def tokens_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, that of the whole sequence; of none, nothing."""
    words = text.translate(_LOWER).split()
    if len(words) < shingle_words:
        found = [xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))] if words else []
        return np.array(found, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle_words + 1
    rolled = hashes[:n].copy()
    for k in range(1, shingle_words):
        rolled = rolled * _FACTORS[k % 3] + _mixed(hashes[k : k + n])
    return np.unique(_mixed(rolled))


def node_of(tokens: np.ndarray) -> int:
    """Number of a set; 0 is the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else 0


def _least(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any partner at least."""
    return -(-percent * n // 100)


def sets(text: str = "text", shingle_words: int = SHINGLE_WORDS) -> Column:
    """Size and number of a text column's sets."""

    @arrow_function("struct<n: long, node: long>")
    def found(texts: pa.Array) -> pa.Array:
        own = [tokens_of(v.as_py(), shingle_words) for v in texts]
        columns = [pa.array([len(t) for t in own], pa.int64()), pa.array([node_of(t) for t in own], pa.int64())]
        return pa.StructArray.from_arrays(columns, ["n", "node"])

    return found(utf8(text))


def _bytes_apart(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: high bytes are mostly zero and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _bytes_together(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def planes(values: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their differences."""
    return _bytes_apart(np.diff(values, prepend=np.uint64(0)).astype(">u8"))


def from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(_bytes_together(data, ">u8").astype(np.uint64), dtype=np.uint64)


_PIECES = "part int, tokens binary, owners binary, nodes binary, sizes binary"


def _pieces(sets: dict[int, np.ndarray], parts: int) -> pa.RecordBatch:
    """The tokens of some sets, a row for each part of the token space."""
    nodes = np.fromiter(sets, np.int64, len(sets))
    sizes = np.array([len(t) for t in sets.values()], np.int32)
    tokens = np.concatenate(list(sets.values()))
    owners = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
    order = np.argsort(tokens)
    tokens, owners = tokens[order], owners[order]
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(parts + 1)))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(tokens)]):
        held, place = np.unique(owners[a:b], return_inverse=True)
        rows.append((
            int(part[a]), planes(tokens[a:b]), _bytes_apart(place.astype(">u4")), nodes[held].tobytes(), sizes[held].tobytes(),
        ))
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [p.split()[0] for p in _PIECES.split(", ")])


def _cut(parts: int, shingle_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for value in batch.column(0):
                tokens = tokens_of(value.as_py(), shingle_words)
                node = node_of(tokens)
                if len(tokens) and node not in sets:
                    sets[node] = tokens
                    held += len(tokens)
                if held >= FLUSH_TOKENS:
                    yield _pieces(sets, parts)
                    sets, held = {}, 0
        if sets:
            yield _pieces(sets, parts)

    return cut


def _shared_in_part(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
    """(node, token, size of the set and sets that hold the token in one number), for the tokens of several sets."""
    tokens, nodes, sizes = [], [], []
    for piece, owners, held, lengths in rows:
        place = _bytes_together(owners, ">u4")
        tokens.append(from_planes(piece))
        nodes.append(np.frombuffer(held, np.int64)[place])
        sizes.append(np.frombuffer(lengths, np.int32)[place])
    tokens, nodes, sizes = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
    order = np.lexsort((nodes, tokens))
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    # Copies of a set bring its tokens more than once.
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes, sizes = tokens[first], nodes[first], sizes[first]
    starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    counts = np.diff(np.append(starts, len(tokens)))
    counts = np.repeat(counts, counts)
    kept = counts > 1
    tokens, nodes, sizes, counts = tokens[kept], nodes[kept], sizes[kept], counts[kept]
    packed = (sizes.astype(np.int64) << 32) | counts
    columns = [pa.array(nodes), pa.array(tokens.view(np.int64)), pa.array(packed)]
    return pa.RecordBatch.from_arrays(columns, ["node", "token", "packed"])


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for k in range(batch.num_rows):
            here = columns[0][k].as_py()
            if here != part and rows:
                yield _shared_in_part(rows)
                rows = []
            part = here
            rows.append(tuple(c[k].as_py() for c in columns[1:]))
    if rows:
        yield _shared_in_part(rows)


def shared_tokens(docs: DataFrame, *, text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, n, tokens, counts) of every distinct set that shares some: its size, and its tokens that other sets hold too.

    Every token of every set goes to its part of the token space, packed; no
    row is larger than ``FLUSH_TOKENS`` allow, and a part holds about
    ``PART_BYTES`` of text's tokens, however often one of them occurs: a token
    of many sets is held once by each.  A part with more of them is read as a
    stream of rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = docs.agg(F.sum(F.octet_length(utf8(text)))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    pieces = docs.select(utf8(text).alias("text")).mapInArrow(_cut(parts, shingle_words), _PIECES)
    tasks = min(parts, MAX_TASKS)
    pieces = pieces.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")
    found = pieces.mapInArrow(_joined_parts, "node long, token long, packed long")
    gathered = found.groupBy("node").agg(F.max("packed").alias("most"), F.collect_list(F.struct("token", "packed")).alias("held"))
    return gathered.select(
        "node", F.shiftright("most", 32).cast("int").alias("n"), F.col("held.token").alias("tokens"),
        F.transform("held.packed", lambda p: p.bitwiseAND(0x7FFFFFFF).cast("int")).alias("counts"),
    )


def _classes(counts: np.ndarray) -> np.ndarray:
    return 1 + (counts > PAIRS).astype(np.int64) + (counts > TRIPLES)


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a set: its shared ``tokens``, the sets that hold each, and its size.

    Frequent tokens are combined inside cells only, which keeps combinations
    few.  The number of cells follows from the size of the smaller partner by
    powers of two, so a set is indexed for its own size and for that of its
    smallest partner.
    """
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    need = n - _least(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.int64)
    found = []
    for level in {n.bit_length() - 1, _least(n, percent).bit_length() - 1}:
        low, mark = 1 << level, np.uint64(level + 1)
        if low < COMBINED_FROM:
            found.append(_mixed(tokens[:need] + mark))
            continue
        classes = _classes(counts)
        cells: dict[tuple[int, int], list[int]] = {}
        covered, alone = 0, 0
        for token, k in zip(tokens.tolist(), classes.tolist()):
            if covered >= need:
                break
            if k == 1:
                covered, alone = covered + 1, alone + 1
                continue
            cell = cells.setdefault((k, token % (low // 16 if k == 2 else low // 8)), [])
            cell.append(token)
            covered += len(cell) >= k
        found.append(_mixed(tokens[:alone] + mark))
        for k in (2, 3):
            combined = [c for (width, _), cell in cells.items() if width == k for c in itertools.combinations(cell, k)]
            if combined:
                held = np.array(combined, np.uint64)
                value = held[:, 0]
                for i in range(1, k):
                    value = value * _FACTORS[i - 1] + held[:, i]
                found.append(_mixed(value + mark))
    return np.unique(np.concatenate(found)).view(np.int64)


def parity_level(n: int) -> int:
    return max(8, n.bit_length() + 1)


def parity_bits(tokens: np.ndarray, n: int) -> bytes:
    """Bit h says whether an odd number of tokens has this hash; two to four bits a token of the whole set."""
    bits = 1 << parity_level(n)
    held = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(bool), bitorder="little").tobytes()


def _indexed(percent: int):
    @arrow_function("struct<entries: array<long>, bits: binary>")
    def indexed(tokens: pa.Array, counts: pa.Array, n: pa.Array) -> pa.Array:
        entries, bits = [], []
        for t, c, size in zip(_lists(tokens), _lists(counts), n.to_pylist()):
            t = t.view(np.uint64)
            entries.append(signatures(t, c, size, percent))
            bits.append(parity_bits(t, size))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32))
        entries = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*entries, np.zeros(0, np.int64)])))
        return pa.StructArray.from_arrays([entries, pa.array(bits, pa.binary())], ["entries", "bits"])

    return indexed("tokens", "counts", "n")


def _lists(lists: pa.ListArray) -> list[np.ndarray]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity rows brought to ``words`` words; both halves go into one."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def likely_pairs(block: dict[str, list], percent: int, mode: str) -> np.ndarray:
    """Pairs of places in a block whose overlap may reach the least similarity.

    ``mode`` "forest": each set with its closest earlier one; "closest": the
    CLOSEST closest pairs of each two labels; "all": all pairs of different
    labels.  With two sides in the block only pairs between them.
    """
    n, shared = np.array(block["n"], np.int64), np.array(block["shared"], np.int64)
    side, labels = np.array(block["side"]), np.array(block["label"], np.int64)
    levels = np.array([parity_level(int(size)) for size in n])
    sides = len(np.unique(side)) > 1
    found, margins = [], []
    for level in np.unique(levels):
        words = (1 << int(level)) // 64
        rows = np.flatnonzero(levels == level)
        bits = {
            at: _folded(np.frombuffer(b"".join(block["bits"][i] for i in np.flatnonzero(levels == at)), np.uint64)
                        .reshape(-1, (1 << int(at)) // 64), words)
            for at in (level, level + 1) if (levels == at).any()
        }
        others = np.concatenate([rows, np.flatnonzero(levels == level + 1)])
        own, against = bits[level], np.concatenate(list(bits.values()))
        step = max(1, (1 << 22) // (words * len(others)))
        for first in range(0, len(rows), step):
            here = rows[first : first + step]
            apart = np.bitwise_count(own[first : first + step, None] ^ against[None]).sum(axis=2, dtype=np.int64)
            margin = (100 + percent) * (shared[here][:, None] + shared[others] - apart) - 2 * percent * (n[here][:, None] + n[others])
            near = margin >= 0
            # Each pair of a level once; all pairs with the next one.
            near &= (levels[others] > level) | (others > here[:, None])
            near &= labels[here][:, None] != labels[others]
            if sides:
                near &= side[here][:, None] != side[others]
            a, b = np.nonzero(near)
            if mode == "forest" and len(a):
                # Of every later set the closest earlier one of this strip.
                order = np.lexsort((-margin[a, b], b))
                a, b = a[order], b[order]
                first_of = np.diff(b, prepend=-1) != 0
                a, b = a[first_of], b[first_of]
            found.append(np.stack([here[a], others[b]], axis=1))
            margins.append(margin[a, b])
    pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
    margins = np.concatenate([*margins, np.zeros(0, np.int64)])
    if mode == "all" or not len(pairs):
        return pairs
    if mode == "forest":
        order = np.lexsort((-margins, pairs[:, 1]))
        pairs = pairs[order]
        return pairs[np.diff(pairs[:, 1], prepend=-1) != 0]
    low, high = np.sort(labels[pairs], axis=1).T
    order = np.lexsort((-margins, high, low))
    pairs, low, high = pairs[order], low[order], high[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.flatnonzero(new)
    return pairs[np.arange(len(pairs)) - np.repeat(starts, np.diff(np.append(starts, len(pairs)))) < CLOSEST]


def _proposed(percent: int, mode: str):
    @arrow_function("array<struct<a: long, b: long>>")
    def proposed(blocks: pa.Array) -> pa.Array:
        pairs = []
        for block in blocks:
            block = block.values
            nodes = block.field("node").to_numpy()
            order = np.argsort(nodes)
            rows = {name: block.field(name).take(pa.array(order)) for name in ("n", "shared", "bits", "side", "label")}
            rows = {name: r.to_pylist() if name == "bits" else r.to_numpy() for name, r in rows.items()}
            pairs.append(nodes[order][likely_pairs(rows, percent, mode)])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
        ends_of = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
        columns = [pa.array(np.ascontiguousarray(ends_of[:, i])) for i in (0, 1)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["a", "b"]))

    return proposed("block")


def _verified(pairs: DataFrame, open_: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) whose similarity is reached, by their tokens."""

    @arrow_function("boolean")
    def similar(left: pa.Array, right: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(_lists(left), _lists(right))]
        sizes = n.to_numpy().astype(np.int64) + m.to_numpy()
        return pa.array((100 + percent) * np.array(common, np.int64) >= percent * sizes)

    one = open_.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    two = open_.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(one, "a").join(two, "b")
    return written(both.filter(similar("a_tokens", "b_tokens", "a_n", "b_n")).select("a", "b"), label)


def _groups(entries: DataFrame, largest: int) -> DataFrame:
    """(kind, key, node, m): each set in its cluster, or, where that has more than ``largest``, in its shared entries.

    A cluster is what index entries connect; m is the size of the group.
    """
    shared = entries.groupBy("entry").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    shared = written(shared.select("entry", "low"), "join-shared")
    members = written(entries.join(shared, "entry").select("entry", "node", "low"), "join-members")
    clusters = component_labels(members.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    sizes = clusters.groupBy("label").agg(F.count("*").alias("m"))
    sized = written(clusters.join(sizes, "label").select("label", "node", "m"), "join-clusters")
    whole = sized.filter(F.col("m") <= largest).select(F.lit(0).alias("kind"), F.col("label").alias("key"), "node", "m")
    parts = members.join(sized.filter(F.col("m") > largest).select("node"), "node").select("entry", "node")
    counts = parts.groupBy("entry").agg(F.count("*").alias("m"))
    parts = parts.join(counts, "entry").select(F.lit(1).alias("kind"), F.col("entry").alias("key"), "node", "m")
    return written(whole.unionByName(parts), "join-groups")


def _blocks(groups: DataFrame, facts: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Groups of more than one label, in pairs of blocks of about ``block`` sets a side."""
    named = groups.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    named = named.withColumn("label", F.coalesce("label", "node")).drop("l_node")
    mixed = named.groupBy("kind", "key").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one < two")
    named = named.join(mixed.select("kind", "key"), ["kind", "key"])
    cut = named.withColumn("cuts", F.expr(f"(m + {block} - 1) div {block}"))
    cut = cut.withColumn("side", F.pmod(F.xxhash64("node"), "cuts"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    rows = cut.join(facts, "node").groupBy("kind", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    return rows.agg(F.collect_list(F.struct("node", "label", "side", "n", "shared", "bits")).alias("block"))


def set_labels(
    docs: DataFrame, *, text: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, cluster: int = CLUSTER, block: int = BLOCK,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """(node, label) of the sets that are linked with others; equal labels where links connect them.

    ``candidates``, pairs (a, b) of nodes found by other means, are verified
    first; what they connect is not compared again.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the index is made for similarities of 50 to 100 hundredths")
    # Sets whose prefix is full of tokens of their own have no partner.
    need = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    open_ = shared_tokens(docs, text=text, shingle_words=shingle_words)
    open_ = written(open_.filter(F.col("n") - F.size("tokens") < need), "join-open")
    indexed = open_.select("node", "n", F.size("tokens").alias("shared"), _indexed(percent).alias("x"))
    indexed = written(indexed.select("node", "n", "shared", "x.entries", "x.bits"), "join-indexed")
    groups = _groups(indexed.select("node", F.explode("entries").alias("entry")), cluster)
    facts = indexed.select("node", "n", "shared", "bits")

    links, labels = None, groups.select("node", F.col("node").alias("label")).limit(0)
    if candidates is not None:
        links = _verified(candidates, open_, percent, "join-candidates")
        labels = component_labels(links)
    for mode in ("forest", "closest", "all"):
        pairs = _blocks(groups, facts, labels, block).select(F.explode(_proposed(percent, mode)).alias("l")).select("l.a", "l.b")
        new = _verified(pairs, open_, percent, f"join-{mode}")
        links = new if links is None else links.unionByName(new)
        labels = component_labels(links)
    return labels


def classes(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    cluster: int = CLUSTER,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents are linked where the Jaccard similarity of their sets is
    ``percent`` hundredths or more; component_id is the smallest doc_id
    reachable over links, itself included.  Equal sets are one node, so copies
    are never paired.  Texts that are null, empty or blank have the empty set,
    which is linked with nothing, not even with its like.  Rows keep their
    number; a null id is never the smallest unless there is no other.

    A pair is found for certain, as prefixes lose none; sets are known by
    64-bit hashes, and so are shingles.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), sets(text, shingle_words).alias("set"))
    rows = written(rows.select("doc_id", "set.n", "set.node"), "join-rows")

    labels = set_labels(docs, text=text, shingle_words=shingle_words, percent=percent, cluster=cluster, block=block)

    named = rows.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    lowest = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("low")).withColumnRenamed("label", "l_label")
    named = named.join(lowest, (F.col("label") == F.col("l_label")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("low"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
