"""Sharding by a two-pass external shuffle, in built-in functions only.

Pass one scatters the records by seeded hashes into buckets that fit in
memory and writes them.  Pass two shuffles each bucket by Fisher-Yates, which
is Spark's ``shuffle`` of an array, and writes it.  The buckets one after the
other are a random order of all rows, and the shards take turns along it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from perioda.llm.common import as_text, col, exploded, fresh, row_marks
from perioda.session import written

#: What a bucket may hold: bytes of the records, and rows.
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 16_384
#: Buckets whose sizes are summed up by one task.
SUMMED = 4096


def add_offsets(counts: DataFrame, bucket: str, rows: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` with ``offset``: the rows in all buckets of the group before.

    In two steps, so that no task sees more than ``SUMMED`` buckets or one row
    for each ``SUMMED`` of them.
    """
    part = counts.withColumn("__part", F.expr(f"{bucket} div {SUMMED}"))
    sums = part.groupBy(*group, "__part").agg(F.sum(rows).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "__part").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__in", F.coalesce(F.sum(rows).over(inside), F.lit(0)))
    same = part["__part"] == sums["__part"]
    for name in group:
        same &= part[name].eqNullSafe(sums[name])
    kept = [part[name] for name in [*group, bucket]]
    return part.join(sums, same).select(*kept, (F.col("__in") + F.col("__base")).alias("offset"))


def shuffled_slots(
    rows: DataFrame, n_shards: int, *, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``rows``, small records with a long ``size`` and ``__copies``, each put at one place.

    The result has shard and slot instead of ``__copies``.  Shard sizes in rows
    differ by one at most, and slots have no gap.
    """
    names = [name for name in rows.columns if name != "__copies"]
    rows = written(rows, "shard-records")
    total = rows.agg(F.sum(F.col("size") * F.col("__copies")).alias("bytes"), F.sum("__copies").alias("rows")).first()
    buckets = max(1, math.ceil((total["bytes"] or 0) / bucket_bytes), math.ceil((total["rows"] or 0) / bucket_rows))
    parts = min(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    record = F.struct("__copy", *map(col, names))
    scattered = (
        exploded(rows, "__copies", "__copy")
        .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__copy", *map(col, names)), F.lit(buckets)))
        .select("__bucket", record.alias("__record"))
        .repartition(parts, "__bucket")
    )
    # Sorted records and sorted buckets: whatever order the shuffle delivers
    # them in, a task that is run again draws the same numbers.
    bucketed = scattered.groupBy("__bucket").agg(F.array_sort(F.collect_list("__record")).alias("__records"))
    bucketed = bucketed.sortWithinPartitions("__bucket")
    drawn = bucketed.select("__bucket", F.posexplode(F.shuffle("__records", F.lit(seed))).alias("__at", "__record"))
    drawn = written(drawn, "shard-buckets")
    offsets = add_offsets(drawn.groupBy("__bucket").agg(F.count("*").alias("__rows")), "__bucket", "__rows")
    placed = drawn.join(offsets, "__bucket").withColumn("__place", F.col("offset") + F.col("__at"))
    return placed.select(
        *[F.col("__record")[name].alias(name) for name in names],
        F.pmod("__place", F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"__place div {n_shards}").alias("slot"),
    )


def assign(docs: DataFrame, n_shards: int = 16, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Size, checksum, shard and slot of every document, without its text.

    One row per row: repeated rows are counted first and get a place each.  A
    null text is empty: its size is 1 and its checksum that of no bytes.  Null
    ids are placed like others, and an empty table gives no rows.  The law is
    ``rows``: the rows of two shards differ by one at most.
    """
    rows = docs.select(
        col(doc_id).alias("doc_id"),
        (F.octet_length(as_text(text)).cast("long") + 1).alias("size"),
        F.crc32(as_text(text).cast("binary")).alias("text_crc32"),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__copies"))
    return shuffled_slots(rows, n_shards, **options)


def shard_rows(docs: DataFrame, n_shards: int = 16, *, text: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with shard and slot.

    Rows are told apart by two hashes over all columns, nulls marked at every
    depth; columns of any type will do, maps included, whose entries count in
    their order.  Equal rows get as many places as there are of them.  A column of ``docs`` with one of the new
    names keeps it, and the new one gets an underscore.
    """
    shard, slot = fresh(docs.columns, "shard", "slot")
    one, two = fresh([*docs.columns, shard, slot], "__one", "__two")
    marked = docs.withColumns(dict(zip((one, two), row_marks(docs))))
    rows = marked.select(
        col(one).alias("one"), col(two).alias("two"), (F.octet_length(as_text(text)).cast("long") + 1).alias("size")
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__copies"))
    places = shuffled_slots(rows, n_shards, **options)
    places = places.select(
        F.col("one").alias(one), F.col("two").alias(two), F.col("shard").alias(shard), F.col("slot").alias(slot)
    )
    return marked.dropDuplicates([one, two]).join(places, [one, two]).drop(one, two)


def write_shards(sharded: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot", files: int = 8) -> None:
    """Write ``shard_rows``: a folder per shard, ``files`` runs of slots in each, in order."""
    part = F.pmod(col(slot), F.lit(files))
    ordered = sharded.repartition(col(shard), part).sortWithinPartitions(col(shard), part, col(slot))
    ordered.write.partitionBy(shard).parquet(path)
