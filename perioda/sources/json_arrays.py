"""Files that hold one JSON array of records, read in splits however large they are.

The text is cut behind every ``}``, wherever that stands.  Most records are
flat, and each piece is one of them.  Where some are not, the borders of
records follow from two things known at no piece by itself: whether it starts
inside a string, and how deep in objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from perioda.session import written

_CLOSE = "}"
#: Text that a task sorts at a time, where files have more; rows take many times that.
_TASK_BYTES = 8 << 20
_SPLIT = ["source", "start"]
# What stands in front of a record, and behind the last one.
_LEAD = r"^[\s\x{FEFF}]*[\[,]?\s*\{"
_TAIL = r"^[\s\x{FEFF}]*\[?\s*\]?\s*$"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of all files under ``path``, each an array of objects, one object, or objects one behind the other.

    A file is read in splits of ``spark.sql.files.maxPartitionBytes``.  A
    record that does not parse, an array or an object without its end, and
    anything but objects in an array raise; an empty file or array has no
    records.  Files are UTF-8.  A comma between two records may be missing.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    pieces = spark.read.option("lineSep", _CLOSE).text(path)
    size = F.col("_metadata.file_size").alias("file_size")
    pieces = pieces.select(F.col("_metadata.file_path").alias("source"), size, place.alias("place"), F.col("value").alias("piece"))
    parts = F.split(_unescaped(F.col("piece")), '"')
    pieces = pieces.withColumns({
        "odd": (F.size(parts) - 1) % 2,
        "from_outside": _braces(parts, 0),
        "from_inside": _braces(parts, 1),
        "tail": F.col("piece").rlike(_TAIL),
    })
    flat = (F.col("odd") == 0) & (F.col("from_outside") == 1)
    files = pieces.groupBy("source").agg(
        F.count_if(~flat).alias("others"),
        F.max_by("tail", "place").alias("tail"),
        F.max_by("piece", "place").alias("last"),
        F.min_by("piece", "place").alias("first"),
        # A byte for each ``}``; one too many if nothing closes the last piece.
        (F.sum(F.octet_length("piece") + 1) > F.max("file_size")).alias("open"),
        F.max("file_size").alias("bytes"),
    )
    is_array = F.col("first").rlike(r"^[\s\x{FEFF}]*\[")
    broken = (F.col("open") & ~F.col("tail")) | (is_array != (F.col("open") & F.col("last").rlike(r"\]\s*$")))
    plain = F.when(F.col("open"), F.col("tail") & (F.col("others") == 1)).otherwise(F.col("others") == 0)
    files = files.select("source", "bytes", broken.alias("broken"), plain.alias("plain"))
    seen = files.agg(
        F.min(F.when(F.col("broken"), F.col("source"))).alias("broken"), F.bool_and("plain").alias("plain"), F.sum("bytes").alias("bytes")
    ).first()
    if seen["broken"]:
        raise ValueError(f"an array or an object has no end: {seen['broken']}")
    records = pieces.filter(flat).select("source", "piece") if seen["plain"] in (True, None) else _joined(pieces, seen["bytes"])
    led = F.when(F.col("piece").rlike(_LEAD), F.regexp_replace("piece", _LEAD, "{"))
    led = F.coalesce(led, F.raise_error(F.concat(F.lit("no record: "), F.left("piece", F.lit(200)))))
    record = F.from_json(F.concat(led, F.lit(_CLOSE)), schema, {"mode": "FAILFAST"})
    return records.select(record.alias("record")).select("record.*")


def _unescaped(text: Column) -> Column:
    """Without the escapes, which may hide a quote; none goes over a ``}``."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\[\s\S]", "")).otherwise(text)


def _braces(parts: Column, start: int) -> Column:
    """Number of ``{`` outside strings if the piece starts outside (0) or inside (1) one."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == start), "")
    return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))


def _joined(pieces: DataFrame, size: int) -> DataFrame:
    """(source, piece) with the pieces of a record joined; ``size`` is that of all files.

    Each split notes how it changes the two states, for a start outside and
    inside a string.  The notes, one a split, are composed in the order of the
    splits; then each piece knows its states, and a second note counts the
    records of several pieces that start in each split, which numbers them.
    The splits are dealt once, to as many tasks as the files' size asks for,
    so a task sorts about ``_TASK_BYTES`` of text, or one split; what is dealt
    is written, and later steps read the columns they need.
    """
    spark = pieces.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    pieces = pieces.withColumns({"start": F.col("place.start"), "row": F.col("place.row")}).drop("place", "file_size")
    pieces = pieces.repartition(tasks, *_SPLIT)
    split = Window.partitionBy(*_SPLIT).orderBy("row")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def sum_of(value: Column | str, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0))

    def change(inside: Column) -> Column:
        """How much deeper a piece ends, its ``}`` included, if that is no part of a string."""
        opened = F.when(inside == 0, F.col("from_outside")).otherwise(F.col("from_inside"))
        return opened - F.when((inside + F.col("odd")) % 2 == 0, 1).otherwise(0)

    pieces = pieces.withColumn("turned", sum_of("odd", before) % 2)
    pieces = pieces.withColumns({"if_outside": change(F.col("turned")), "if_inside": change(1 - F.col("turned"))})
    pieces = pieces.withColumns({"deep_outside": sum_of("if_outside", before), "deep_inside": sum_of("if_inside", before)})
    pieces = written(pieces, "array-pieces")
    notes = pieces.groupBy(*_SPLIT).agg(
        (F.sum("odd") % 2).alias("turns"), F.sum("if_outside").alias("change_outside"), F.sum("if_inside").alias("change_inside")
    )
    notes = notes.withColumn("state", sum_of("turns", earlier) % 2)
    changes = F.when(F.col("state") == 0, F.col("change_outside")).otherwise(F.col("change_inside"))
    notes = notes.withColumn("base", sum_of(changes, earlier))
    pieces = _with_notes(pieces, notes, "state", "base")
    pieces = pieces.withColumn("inside", (F.col("turned") + F.col("state")) % 2)
    outside = F.col("state") == 0
    pieces = pieces.withColumn("change", F.when(outside, F.col("if_outside")).otherwise(F.col("if_inside")))
    pieces = pieces.withColumn("depth", F.col("base") + F.when(outside, F.col("deep_outside")).otherwise(F.col("deep_inside")))
    begins, ends = (F.col("depth") == 0) & (F.col("inside") == 0), F.col("depth") + F.col("change") == 0
    ends = ends & ((F.col("inside") + F.col("odd")) % 2 == 0)
    # Behind the last record of a file nothing is opened, and nothing is closed.
    pieces = pieces.filter(~(begins & F.col("tail") & (F.col("from_outside") == 0) & (F.col("change") == -1)))
    pieces = pieces.withColumns({"begins": begins.cast("int"), "ends": ends})
    alone = (F.col("begins") == 1) & F.col("ends")
    parts = written(pieces.filter(~alone).select(*_SPLIT, "row", "piece", "begins"), "array-parts")
    counts = parts.groupBy(*_SPLIT).agg(F.sum("begins").alias("begun"))
    counts = counts.withColumn("records", sum_of("begun", earlier))
    parts = _with_notes(parts.repartition(tasks, *_SPLIT), counts, "records")
    parts = parts.withColumn("record", F.col("records") + F.sum("begins").over(split))
    several = parts.groupBy("source", "record").agg(F.array_sort(F.collect_list(F.struct("start", "row", "piece"))).alias("parts"))
    whole = several.select("source", F.array_join("parts.piece", _CLOSE).alias("piece"))
    return pieces.filter(alone).select("source", "piece").unionByName(whole)


def _with_notes(pieces: DataFrame, notes: DataFrame, *names: str) -> DataFrame:
    notes = notes.select(F.col("source").alias("__of"), F.col("start").alias("__at"), *names)
    joined = pieces.join(notes, (F.col("source") == F.col("__of")) & (F.col("start") == F.col("__at")))
    return joined.drop("__of", "__at")
