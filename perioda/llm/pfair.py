"""Mixing sources to target weights by Pfair scheduling.

A source with weight w releases its block j at slot floor((j-1)/w) and has to
place it before slot ceil(j/w).  Earliest deadline first among the released
blocks then keeps every source within one block of its target at every slot.
The windows come from the exact weights over the whole mix, so the gap to the
asked shares does not grow with its length.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from perioda.llm.common import col, exploded, fresh, row_marks, ship_package
from perioda.llm.sharding import add_offsets
from perioda.session import written

BLOCK_ROWS = 64
#: Slots that are handed on at a time.
SLOT_BATCH = 65_536
#: Rows that are numbered by one task at a time.
BUCKET_ROWS = 4_096
#: Default weights are the sources' row counts to this power, so small sources gain a little.
TEMPER = 0.9


def whole_weights(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Weights as whole numbers of at least 1 that sum up to ``period``, by largest remainder."""
    names = sorted((n for n, w in weights.items() if w > 0), key=lambda n: (n is None, n))
    if len(names) > period:
        raise ValueError(f"{len(names)} sources need a period of as many slots at least")
    if not names:
        return {}
    total = sum(weights[n] for n in names)
    spare = period - len(names)
    exact = {n: max(0.0, weights[n] / total * period - 1) for n in names}
    scale = spare / sum(exact.values()) if sum(exact.values()) else 0.0
    found = {n: 1 + math.floor(exact[n] * scale) for n in names}
    rest = sorted(names, key=lambda n: (found[n] - 1 - exact[n] * scale, names.index(n)))
    left = period - sum(found.values())
    for k in range(left):
        found[rest[k % len(rest)]] += 1
    return found


def schedule(weights: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """For each slot of a period, the source and the number of its block, from 0."""
    period, names = sum(weights.values()), list(weights)
    releases = [(0, k, 0) for k in range(len(names))]
    heapq.heapify(releases)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for slot in range(period):
        while releases and releases[0][0] <= slot:
            _, k, j = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[names[k]]), k, j))
        _, k, j = heapq.heappop(ready)
        slots.append((names[k], j))
        if j + 1 < weights[names[k]]:
            heapq.heappush(releases, ((j + 1) * period // weights[names[k]], k, j + 1))
    return slots


def exact_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the ratio of the positive weights."""
    exact = {n: Fraction(w) for n, w in weights.items() if w > 0}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    return {n: int(w * scale) for n, w in exact.items()}


def slots_until(weights: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int]]:
    """For each slot the number of a source and its turn, from 0, until each source has had ``blocks`` turns."""
    total, left = sum(weights), sum(blocks)
    releases = [(0, k, 0) for k in range(len(weights))]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while left:
        while releases and releases[0][0] <= slot:
            _, k, j = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[k]), k, j))
        _, k, j = heapq.heappop(ready)
        yield k, j
        left -= j < blocks[k]
        heapq.heappush(releases, ((j + 1) * total // weights[k], k, j + 1))
        slot += 1


def slots_table(spark: SparkSession, weights: Sequence[int], blocks: Sequence[int]) -> DataFrame:
    """``slots_until`` as rows (k, turn, slot), made on an executor a batch at a time and written."""
    ship_package(spark)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from _slot_batches(weights, blocks)

    return written(spark.range(1, numPartitions=1).mapInArrow(made, "k long, turn long, slot long"), "mix-slots")


def _slot_batches(weights: Sequence[int], blocks: Sequence[int]) -> Iterator[pa.RecordBatch]:
    rows, first = [], 0
    for row in slots_until(weights, blocks):
        rows.append(row)
        if len(rows) == SLOT_BATCH:
            yield _slot_batch(rows, first)
            rows, first = [], first + len(rows)
    if rows:
        yield _slot_batch(rows, first)


def _slot_batch(rows: list[tuple[int, int]], first: int) -> pa.RecordBatch:
    columns = [[k for k, _ in rows], [turn for _, turn in rows], range(first, first + len(rows))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "turn", "slot"])


def chosen_weights(
    counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, period: int | None
) -> dict[str | None, int]:
    """Whole-number weights of the sources that have rows and a positive weight."""
    if weights is None:
        weights = {name: n**TEMPER for name, n in counts.items()}
    chosen = {name: w for name, w in weights.items() if counts.get(name)}
    return exact_weights(chosen) if period is None else whole_weights(chosen, period)


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    source: str = "source",
    seed: int = 0,
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` mixed by blocks: source_block, epoch, slot and place behind its columns.

    Every source's rows are put in a seeded random order and cut into blocks of
    ``block_rows``; ``slot`` is the block's place in the mix and ``place`` the
    row's place in the block.  The mix ends at the first slot by which every
    source has placed all its blocks, so no row is left out; a source that is
    through before starts again, and its rows return with the next ``epoch``.
    At every slot each source has placed its weight's share within one block.

    ``weights`` gives positive shares by source; without it they are the row
    counts to the power TEMPER.  A null source is a source like others.  A
    source without a weight has target 0 and is not in the mix; a weight
    without rows is left out before weights are scaled.  An empty table stays
    empty.  Columns may be of any type, maps included; rows that differ
    anywhere, if only by a null inside a value, are different rows.  Equal rows are each placed; of a row repeated beyond a block's
    size the copies are numbered like different rows.

    Shares are met exactly, however long the mix is and however many sources
    there are.  With a ``period`` they are rounded to multiples of its inverse,
    at least one each, and there may be as many sources as it has slots.  A
    small weight makes a long mix.  The names of the sources go through the driver.
    """
    names = docs.columns
    block, epoch, slot, place = fresh(names, "source_block", "epoch", "slot", "place")
    one, two = fresh([*names, block, epoch, slot, place], "__one", "__two")
    marked = docs.withColumns(dict(zip((one, two), row_marks(docs))))
    rows = marked.select(col(source).cast("string").alias("source"), col(one).alias("one"), col(two).alias("two"))
    rows = written(rows.groupBy("source", "one", "two").agg(F.count("*").alias("copies")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("copies").alias("rows"))
    found = (totals if period is None else totals.limit(period + 1)).collect()
    if period is not None and len(found) > period:
        raise ValueError(f"more than {period} sources; a longer period is needed")
    counts = {row["source"]: row["rows"] for row in found}

    weights = chosen_weights(counts, weights, period)
    placed = place_rows(rows, counts, weights, seed=seed, block_rows=block_rows, bucket_rows=bucket_rows)
    placed = placed.select(
        F.col("one").alias(one), F.col("two").alias(two), F.col("block").alias(block),
        F.col("epoch").alias(epoch), F.col("slot").alias(slot), F.col("place").alias(place),
    )
    return marked.dropDuplicates([one, two]).join(placed, [one, two]).drop(one, two)


def place_rows(
    rows: DataFrame, counts: Mapping[str | None, int], weights: Mapping[str | None, int], *, seed: int, block_rows: int, bucket_rows: int
) -> DataFrame:
    """Compact rows (source, one, two, copies) -> one row for each place in the mix."""
    spark = rows.sparkSession
    names = list(weights)
    blocks = [-(-counts[name] // block_rows) for name in names]
    slots = slots_table(spark, [weights[name] for name in names], blocks)
    facts = [(k, name, math.ceil(counts[name] / bucket_rows), blocks[k]) for k, name in enumerate(names)]
    facts = spark.createDataFrame(facts, "k long, name string, buckets long, blocks long")
    wanted = slots.groupBy(F.col("k").alias("w")).agg(F.count("*").alias("wanted"))
    facts = F.broadcast(written(facts.join(wanted, F.col("k") == F.col("w")).drop("w"), "mix-sources"))
    taken = exploded(rows, "copies", "copy").join(facts, F.col("source").eqNullSafe(F.col("name")))

    # Each source's rows in hashed buckets of a bounded size; numbers inside a
    # bucket and the rows before it give the number in the source.
    order = F.xxhash64(F.lit(seed), "one", "two", "copy")
    taken = taken.withColumn("order", order).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), "buckets"))
    counts = taken.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    offsets = add_offsets(counts, "bucket", "n", ("source",)).withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = Window.partitionBy("source", "bucket").orderBy("order", "one", "two", "copy")
    numbered = taken.withColumn("number", F.row_number().over(inside) - 1)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    numbered = numbered.join(offsets, same).withColumn("number", F.col("number") + F.col("offset"))
    numbered = numbered.withColumn("block", F.expr(f"number div {block_rows}"))
    numbered = numbered.withColumn("place", (F.col("number") % block_rows).cast("int"))

    # Block b of a source with n blocks is its block b, b + n, b + 2n ... in the mix.
    rounds = F.expr("(wanted - block + blocks - 1) div blocks")
    again = exploded(numbered.withColumn("rounds", rounds).filter("rounds > 0"), "rounds", "epoch")
    again = again.withColumn("turn", F.col("block") + F.col("epoch") * F.col("blocks"))
    again = again.withColumnRenamed("k", "a_k").withColumnRenamed("turn", "a_turn")
    joined = again.join(slots, (F.col("a_k") == F.col("k")) & (F.col("a_turn") == F.col("turn")))
    return joined.select("source", "one", "two", "block", "epoch", "slot", "place")


def ordered(mixed: DataFrame, *, slot: str = "slot", place: str = "place") -> DataFrame:
    """Rows of ``mix`` laid out in its order, for writing."""
    return mixed.repartitionByRange(col(slot), col(place)).sortWithinPartitions(col(slot), col(place))
