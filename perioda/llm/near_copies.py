"""One document of each class of texts whose sets of word shingles are alike.

Texts are linked where their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  SimHash fingerprints with a Golay key in common
propose the first pairs, which are verified on the sets.  Near copies whose
fingerprints differ in more bits share no key (at 0.8 about 15 of 100 bits
differ); the exact join over token combinations finds what they leave.

Who stays is decided on ids and digests.  The texts themselves stay where they
are: a bit map of the rows that go is sent to all, rows whose bit is not set
pass, and only the others are joined with the rows that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm import jaccard_join, simhash
from perioda.llm.common import col, fresh, utf8
from perioda.llm.simhash import one_row_a_class
from perioda.session import written

SHINGLE_WORDS = 5
#: Least similarity, in hundredths.
PERCENT = 80
#: The bit map has this many bits for a row in it, up to 8 MB; beyond, more rows are joined.
BITS_A_ROW, MOST_BITS = 16, 1 << 26
#: Bits in one value of Spark's bit map functions.
PAGE = 1 << 15


def _digest(text: str) -> Column:
    return F.unhex(F.md5(utf8(text)))


def _place(doc_id: Column, digest: Column, bits: int) -> Column:
    """Bit of a row, from 1, as the bit map functions count."""
    return F.pmod(F.xxhash64(doc_id, digest), F.lit(bits)) + 1


def bit_map(rows: DataFrame, bits: int) -> DataFrame:
    """(page, map) of the rows' (id, digest); 8 MB at most."""
    place = rows.select(_place(F.col("id"), F.col("digest"), bits).alias("at"))
    return place.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))


def with_bit(docs: DataFrame, pages: DataFrame, bits: int, *, doc_id: str, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: whether the row's bit is set."""
    at, page, held = fresh([*docs.columns, out], "__at", "__page", "__map")
    pages = pages.select(F.col("page").alias(page), F.col("map").alias(held))
    marked = docs.withColumn(at, _place(col(doc_id), _digest(text), bits))
    marked = marked.join(F.broadcast(pages), F.bitmap_bucket_number(col(at)) == col(page), "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{held}`, cast(bitmap_bit_position(`{at}`) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position(col(at)) % 8).cast("int")) == 1, F.lit(False))
    return marked.withColumn(out, bit).drop(at, page, held)


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) nodes that fingerprints propose, from (node, fp): equal ones, and those linked through Golay keys.

    A fingerprint stands for its sets by the smallest node; the others are
    paired with that one.
    """
    nodes = written(rows.filter("node <> 0").select("node", "fp").distinct(), "near-prints")
    lows = written(nodes.groupBy("fp").agg(F.min("node").alias("low")), "near-lows")
    equal = nodes.join(lows, "fp").filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = simhash.links_between(lows.select("fp"))
    low = lambda of, name: lows.select(F.col("fp").alias(of), F.col("low").alias(name))
    near = links.withColumnsRenamed({"a": "f", "b": "g"}).join(low("f", "a"), "f").join(low("g", "b"), "g")
    return equal.unionByName(near.select("a", "b"))


def keep_one(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (null last), text and other columns.

    Texts that are null, empty or blank are one class.  Rows without an id, or
    with one id in different classes, are not mixed up.  Columns may have any
    names and be of any type.
    """
    node, fp = jaccard_join.sets(text, shingle_words)["node"].alias("node"), simhash.fingerprints(text, shingle_words).alias("fp")
    rows = written(docs.select(col(doc_id).alias("id"), _digest(text).alias("digest"), node, fp), "near-rows")
    labels = jaccard_join.set_labels(
        docs, text=text, shingle_words=shingle_words, percent=percent, candidates=simhash_pairs(rows)
    ).withColumnRenamed("node", "l_node")
    named = rows.join(labels, F.col("node") == F.col("l_node"), "left")
    named = written(named.select("id", "digest", F.coalesce("label", "node").alias("label")), "near-labels")

    # (label, id) is no hot key, however large a class is.
    lowest = named.groupBy("label").agg(F.min("id").alias("low")).withColumnRenamed("label", "of")
    is_low = (F.col("label") == F.col("of")) & F.col("id").eqNullSafe(F.col("low"))
    first = written(named.join(lowest, is_low, "left_semi"), "near-first")
    several = first.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n")).filter("n > 1")
    tied = first.join(several, F.col("label") == F.col("of"), "left_semi").distinct()
    gone = named.join(lowest, is_low, "left_anti").select("id", "digest", F.lit(None).cast("long").alias("label"))
    special = written(gone.unionByName(tied.select("id", "digest", "label")), "near-gone")

    bits = PAGE
    while bits < min(MOST_BITS, BITS_A_ROW * special.count()):
        bits *= 2
    maybe, own, mark, label = fresh(docs.columns, "__maybe", "__id", "__digest", "__label")
    marked = with_bit(docs, written(bit_map(special, bits), "near-bits"), bits, doc_id=doc_id, text=text, out=maybe)
    keys = special.select(F.col("id").alias(own), F.col("digest").alias(mark), F.col("label").alias(label))
    same = col(doc_id).eqNullSafe(col(own)) & (_digest(text) == col(mark))
    held = marked.filter(col(maybe))
    kept = marked.filter(~col(maybe)).unionByName(held.join(keys, same, "left_anti")).select(*map(col, docs.columns))
    tied = held.join(keys.filter(col(label).isNotNull()), same).select(*map(col, docs.columns), col(label))
    return kept.unionByName(one_row_a_class(tied, label, doc_id=doc_id, text=text))
