"""Near-duplicates by SimHash fingerprints and Golay keys.

A 64-bit fingerprint is cut into three segments.  If two fingerprints differ
in two bits at most, then for one of the three pairs (segment, the next one)
the first is equal and the second differs in one bit at most: the pairs look
at every segment once as first and once as second, and two errors can't spoil
all three.  So each fingerprint gets, for each pair, the first segment with
the index of each Golay codeword near the second one, and fingerprints with a
key in common are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, col, fresh, told_apart, utf8
from perioda.llm.components import component_labels
from perioda.llm.golay import nearby_indices
from perioda.session import written

BITS = 64
MAX_DIFFERENCE = 2
SHINGLE_WORDS = 3
SEED = 42
#: (first bit, bits) of the segments; each fits a codeword.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Buckets up to this size are compared inside one row; larger ones go by midpoints.
BUCKET = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle_words + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 4096):
        octets = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str = "text", shingle_words: int = SHINGLE_WORDS) -> Column:
    """Signed 64-bit fingerprint of a text column."""

    @arrow_function("long")
    def printed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(v.as_py(), shingle_words) for v in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return printed(utf8(text))


def golay_keys(prints: np.ndarray) -> np.ndarray:
    """Three times six keys a fingerprint, repeats included."""
    values = prints.view(np.uint64)
    parts = [((values >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    keys = []
    for k, exact in enumerate(parts):
        near = nearby_indices(parts[(k + 1) % len(parts)])
        keys.append((np.int64(k) << 40) | (exact[:, None] << 12) | near)
    return np.concatenate(keys, axis=1)


def keys_of(fp: str) -> Column:
    """The distinct keys of a fingerprint column."""

    @arrow_function("array<long>")
    def keyed(prints: pa.Array) -> pa.Array:
        keys = np.sort(golay_keys(prints.to_numpy(zero_copy_only=False).astype(np.int64)), axis=1)
        first = np.ones(keys.shape, bool)
        first[:, 1:] = keys[:, 1:] != keys[:, :-1]
        ends = np.concatenate([[0], np.cumsum(first.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[first]))

    return keyed(col(fp))


def bucket_links(members: np.ndarray, max_difference: int) -> np.ndarray:
    """Pairs that join what belongs together in a bucket: one less than members of each class."""
    values = np.unique(members)
    unsigned, links = values.view(np.uint64), []
    open_ = np.ones(len(values), bool)
    for root in range(len(values)):
        if not open_[root]:
            continue
        open_[root], waiting = False, [root]
        while waiting:
            at = waiting.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(unsigned ^ unsigned[at]) <= max_difference))
            links.append(np.stack([np.full(len(near), values[at]), values[near]], axis=1))
            open_[near] = False
            waiting += near.tolist()
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def links_of_buckets(buckets: pa.ListArray, max_difference: int) -> pa.ListArray:
    """``bucket_links`` of every bucket, in arrays throughout: a batch can hold many large buckets."""
    values, ends = buckets.values.to_numpy(), buckets.offsets.to_numpy()
    found = [bucket_links(values[a:b], max_difference) for a, b in zip(ends, ends[1:])]
    pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    columns = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["a", "b"]))


def links_between(prints: DataFrame, max_difference: int = MAX_DIFFERENCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links over distinct fingerprints ``fp`` that leave no class apart.

    Every link differs in ``max_difference`` bits (2 or less) at most, and any
    two fingerprints that do are connected by links.  A bucket of more than
    ``bucket`` fingerprints is never gathered: fingerprints at distance 2 or
    less are those with a neighbour at distance 1 or less in common, so its
    members are grouped by their 65 neighbours and each group is linked to
    its smallest member.  Linear in the members, and as exact.
    """
    if not 0 <= max_difference <= 2:
        raise ValueError("the keys find differences of 0 to 2 bits")
    keyed = written(prints.select("fp", F.explode(keys_of("fp")).alias("key")), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    sizes = written(sizes.filter("n > 1"), "simhash-buckets")
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    links = sizes.filter("n = 2").filter(apart("low", "high") <= max_difference).select(
        F.col("low").alias("a"), F.col("high").alias("b")
    )

    @arrow_function("array<struct<a: long, b: long>>")
    def linked(members: pa.Array) -> pa.Array:
        return links_of_buckets(members, max_difference)

    small = keyed.join(sizes.filter((F.col("n") > 2) & (F.col("n") <= bucket)).select("key"), "key")
    gathered = small.groupBy("key").agg(F.collect_list("fp").alias("members")).select(F.explode(linked("members")).alias("l"))
    links = links.unionByName(gathered.select("l.a", "l.b"))

    hot = keyed.join(sizes.filter(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    if max_difference == 2:
        links = links.unionByName(_midpoint_links(hot))
    else:
        links = links.unionByName(_neighbour_links(hot, max_difference))
    return links.distinct()


def _neighbours(fp: Column) -> Column:
    flips = [F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)]]
    return F.transform(F.array(*flips), lambda flip: fp.bitwiseXOR(flip))


def _midpoint_links(hot: DataFrame) -> DataFrame:
    points = hot.select("fp", F.explode(_neighbours(F.col("fp"))).alias("point"))
    lowest = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    shared = points.join(lowest.filter("low < high").select("point", "low"), "point")
    return shared.filter("low < fp").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def _neighbour_links(hot: DataFrame, max_difference: int) -> DataFrame:
    if max_difference == 0:
        return hot.filter("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    points = hot.select("fp", F.explode(_neighbours(F.col("fp"))).alias("point"))
    others = hot.select(F.col("fp").alias("point"))
    return points.join(others, "point").filter("fp < point").select(F.col("fp").alias("a"), F.col("point").alias("b"))


def classes(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_difference: int = MAX_DIFFERENCE,
    bucket: int = BUCKET,
) -> DataFrame:
    """doc_id, fingerprint (signed) and component_id of every document.

    Equal fingerprints are one node, so copies are never paired.  Texts that
    are null, empty or blank have fingerprint 0 and are linked like others.
    component_id is the smallest doc_id reachable over links; a null id is
    never the smallest unless there is no other.  Rows keep their number.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), fingerprints(text, shingle_words).alias("fp"))
    rows = written(rows, "simhash-fingerprints")
    named = _labelled(rows, max_difference, bucket)
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    found = named.join(lowest, "label").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def _named(
    docs: DataFrame, *, doc_id: str, text: str, shingle_words: int = SHINGLE_WORDS,
    max_difference: int = MAX_DIFFERENCE, bucket: int = BUCKET,
) -> DataFrame:
    rows = docs.select(col(doc_id).alias("doc_id"), fingerprints(text, shingle_words).alias("fp"))
    return written(_labelled(rows, max_difference, bucket), "simhash-labels")


def _labelled(rows: DataFrame, max_difference: int, bucket: int) -> DataFrame:
    """fp, its smallest doc_id ``low`` and the label of its class, for every distinct fingerprint."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    labels = component_labels(links_between(nodes.select("fp"), max_difference, bucket))
    # Fingerprints without a link are their own class.
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "low", F.coalesce("label", "fp").alias("label")
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; its columns stay.

    Classes are told apart by their label, not by an id, so rows without an id
    or with the same id but in different classes are not mixed up.  Of several
    rows of a class with its smallest id (null last), the one with the smallest
    text, then the smallest other columns (of any type, maps by their entries), stays.
    """
    print_, found, label = fresh(docs.columns, "__print", "__found", "__label")
    shingle_words = options.get("shingle_words", SHINGLE_WORDS)
    named = _named(docs, doc_id=doc_id, text=text, **options).select(F.col("fp").alias(found), F.col("label").alias(label))
    marked = docs.withColumn(print_, fingerprints(text, shingle_words))
    marked = marked.join(named, col(print_) == col(found)).select(*map(col, docs.columns), col(label))
    return one_row_a_class(marked, label, doc_id=doc_id, text=text)


def one_row_a_class(marked: DataFrame, label: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each label with the smallest id (null last), text and other columns; the label goes."""
    names = [c for c in marked.columns if c != label]
    kinds = {f.name: f.dataType for f in marked.schema}
    of, low, row = fresh(marked.columns, "__of", "__low", "__row")
    lowest = marked.groupBy(col(label).alias(of)).agg(F.min(col(doc_id)).alias(low))
    # Before texts are compared, so that few of them are moved; ids in the key spread a large class.
    near = marked.join(lowest, (col(label) == col(of)) & col(doc_id).eqNullSafe(col(low)), "left_semi")
    first = [text, *[c for c in names if c not in (text, doc_id)]]
    order = F.struct(*[told_apart(col(c), kinds[c]).alias(f"c{i}") for i, c in enumerate(first)])
    whole = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(names)])
    picked = near.groupBy(col(label)).agg(F.min_by(whole, order).alias(row))
    return picked.select(*[col(row)[f"o{i}"].alias(c) for i, c in enumerate(names)])
