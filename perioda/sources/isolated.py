"""Parquet folders in which some files cannot be read: the rest is read, and the bad ones are named."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from perioda.session import written

#: Files up to this size are looked into for the reason; a larger one without rows is named without it.
LOOK_INTO_BYTES = 256 << 20
BAD_FILES = "path string, reason string"
_FILE = "_metadata.file_path"


def _reason(content: bytes) -> str | None:
    """Why these bytes are no Parquet file; None if they are one."""
    try:
        pq.read_metadata(pa.BufferReader(content))
    except (pa.ArrowException, OSError) as error:
        return str(error).splitlines()[0]
    return None


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files at ``path`` whose Parquet footer cannot be read.

    Footers are read by Spark's own reader, in parallel, and no column with
    them.  Only files that gave no row are looked into; a whole file without
    rows is not bad.  Files without a byte, and those whose names begin with
    ``_`` or ``.``, are passed over, as by any scan of Spark.  The names of
    files without rows go through the driver, as all names do when Spark
    lists a folder.
    """
    listed = spark.read.format("binaryFile").load(path)
    # An empty schema: nothing but the footers' row counts is read.
    rows = spark.read.schema(T.StructType()).option("ignoreCorruptFiles", "true").parquet(path)
    readable = rows.select(F.col(_FILE).alias("file")).distinct()
    names = listed.select(F.col(_FILE).alias("file"), "length")
    silent = [tuple(row) for row in names.join(readable, "file", "left_anti").collect()]
    small = [file for file, length in silent if length <= LOOK_INTO_BYTES]
    large = [(file, "no readable footer") for file, length in silent if length > LOOK_INTO_BYTES]

    def looked_into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(str(file), _reason(content.as_buffer())) for file, content in zip(*batch.columns)]
            found = [(file, reason) for file, reason in found if reason]
            columns = [pa.array([row[k] for row in found], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["path", "reason"])

    # The filter is applied to the listing, so that no other file's content is read.
    chosen = listed.filter(F.col(_FILE).isin(small)).select(F.col(_FILE).alias("file"), "content")
    found = chosen.mapInArrow(looked_into, BAD_FILES)
    return found.unionByName(spark.createDataFrame(large, BAD_FILES))


def read_readable(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of all readable files at ``path``, and (path, reason) of the others.

    A file without a readable footer, such as one that was cut off, is left
    out of the scan and named.  The footer is all that is tried beforehand:
    damage behind a whole footer still ends the scan, as rows would be lost
    without a word otherwise.
    """
    bad = written(bad_files(spark, path), "bad-files")
    names = [row["path"] for row in bad.select("path").collect()]
    rows = spark.read.schema(schema).parquet(path)
    return (rows.filter(~F.col(_FILE).isin(names)) if names else rows), bad
