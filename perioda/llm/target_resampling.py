"""Importance resampling towards a target distribution.

Hashed features of all documents and of all target texts give an array of
gains; a document's weight is the sum of its features' gains.  With Gumbel
noise added, the highest scores are a draw without replacement in proportion
to the exponential of the weights.  Their cutoff is bracketed by a quantile
sketch; exact counts outside the bracket prove or widen it, and only the rows
in the bracket are sorted to find it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from perioda.llm.common import arrow_function, col, ship_package, utf8
from perioda.llm.sharding import add_offsets
from perioda.session import written

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: 1 / the sketch's rank error, and the rows that one task numbers.
ACCURACY, TASK_ROWS = 10_000, 1_000_000

_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class _Buckets(dict):
    """Buckets of features, remembered; emptied when it has too many."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def buckets_of(text: bytes, known: _Buckets, max_words: int = MAX_WORDS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature: each run of 1 to ``max_words`` words, repeats included."""
    words = text.translate(_SPACED).split()
    features = words
    for n in range(2, max_words + 1):
        features = features + [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """How many features of all texts fall in each bucket; one row for a bucket and task is shuffled at most."""
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                _, found = buckets_of(value.as_py(), known, max_words)
                np.add.at(counts, found, 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = docs.select(utf8(text).alias("text")).mapInArrow(counted, "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    buckets, every, wanted = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * float(every + buckets) / ((s + 1) * float(wanted + buckets))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighed(text: str, gain: np.ndarray, max_words: int = MAX_WORDS) -> Column:
    """n_words, n_features and weight of a text column."""
    known = _Buckets(len(gain))

    @arrow_function("struct<n_words: long, n_features: long, weight: long>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [(words, len(own), int(gain[own].sum())) for words, own in (buckets_of(v.as_py(), known, max_words) for v in texts)]
        columns = list(zip(*rows)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return found(utf8(text))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0))).cast("long")


def bracket(scored: DataFrame, wanted: int, rows: int, *, score: str = "score", accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the ``wanted``-th highest score is between low and high; ``above`` rows are beyond high.

    The sketch says where to look; the counts are exact.  A bracket that they
    refute is widened eightfold until, at last, it holds everything.
    """
    slack = 2 / accuracy
    while True:
        ends = [max(0.0, 1 - wanted / rows - slack), min(1.0, 1 - wanted / rows + slack)]
        low, high = scored.agg(F.percentile_approx(col(score), ends, accuracy).alias("ends")).first()["ends"]
        if slack >= 1:
            low, high = scored.agg(F.min(col(score)), F.max(col(score))).first()
        outside = scored.agg(F.count_if(col(score) > high).alias("above"), F.count_if(col(score) >= low).alias("from_low")).first()
        if outside["above"] < wanted <= outside["from_low"]:
            return low, high, outside["above"]
        slack *= 8


def numbered(rows: DataFrame, order: list[Column], count: int, *, out: str = "rank", task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` with their number, from 1, in the order: range partitioned, and each range numbered by itself."""
    parts = max(1, math.ceil(count / task_rows))
    spread = written(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id().cast("long")), "ranges")
    offsets = add_offsets(spread.groupBy("__range").agg(F.count("*").alias("__n")), "__range", "__n")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = spread.withColumn(out, inside).join(offsets, "__range")
    return placed.withColumn(out, (col(out) + F.col("offset")).cast("long")).drop("__range", "offset")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    accuracy: int = ACCURACY,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with ``min_words`` words or more, the ``percent``
    hundredths (rounded down) with the highest scores are drawn.  Ties go to
    the smaller id; a null id is behind all others and has the noise of an
    empty one; rows with equal ids go by weight, then number of features, and
    equal rows each have a rank.  Null and empty texts have no features and
    weight 0.  An empty table has no rows, and an empty target still gives
    weights.
    """
    gain = gains(
        bucket_counts(docs, text=text, buckets=buckets, max_words=max_words),
        bucket_counts(target, text=target_text, buckets=buckets, max_words=max_words),
    )
    rows = docs.select(col(doc_id).alias("doc_id"), weighed(text, gain, max_words).alias("w"))
    rows = rows.select("doc_id", "w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows, "resample-scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    eligible = rows.filter(F.col("n_words") >= min_words)
    count = eligible.count()
    wanted = percent * count // 100
    if not wanted:
        return rows.select(*columns, undrawn)
    low, high, above = bracket(eligible, wanted, count, accuracy=accuracy)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    inside = eligible.filter(F.col("score").between(low, high))
    inside = written(numbered(inside, order, inside.count(), out="at", task_rows=task_rows), "resample-bracket")
    drawn = eligible.filter(F.col("score") > high).select(*columns)
    drawn = drawn.unionByName(inside.filter(F.col("at") <= wanted - above).select(*columns))
    ranked = numbered(drawn, order, wanted, task_rows=task_rows).select(*columns, "rank")
    rest = [
        rows.filter(F.col("n_words") < min_words),
        eligible.filter(F.col("score") < low),
        inside.filter(F.col("at") > wanted - above),
    ]
    for part in rest:
        ranked = ranked.unionByName(part.select(*columns, undrawn))
    return ranked
