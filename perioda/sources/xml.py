"""Health records from XML exports, plain or zipped.

A record is cut off at every ``<Record``, so one large export is read in
splits by many tasks; only the start tag matters, children are ignored.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perioda.sources.files import Opener, open_file

# Record types that are kept, and the prefix of their names.
TYPE_PREFIX = "HKQuantityTypeIdentifier"
KEPT_TYPES = (
    "BloodPressureDiastolic",
    "BloodPressureSystolic",
    "BodyFatPercentage",
    "BodyMass",
    "BodyMassIndex",
    "DistanceWalkingRunning",
    "StepCount",
)
EXPORT_MEMBER = "apple_health_export/export.xml"

RECORD = "<Record"
_ATTRIBUTES = "_type string, _unit string, _value string, _startDate string"
# Attribute values may hold '>' as long as they are quoted.  Runs are taken
# whole and never given back, so a long tag needs no deep stack.
_START_TAG = r"""^(\s(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
_OPEN_TAG = re.compile(RECORD + r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_CHUNK_CHARS = 1 << 20
#: Packed bytes that a task unpacks, where there are more members than cores.
_PACKED_PER_TASK = 64 << 20
MAX_TAG_CHARS = 16 << 20


def read_metrics_xml(spark: SparkSession, path: str, *, keep_time: bool = False, on_error: str = "raise") -> DataFrame:
    """(source, dt, metric, unit, value) of the kept record types in the files."""
    pieces = spark.read.option("lineSep", RECORD).text(path)
    return parse_records(
        pieces.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("piece")),
        keep_time=keep_time,
        on_error=on_error,
    )


def read_metrics_zip(
    spark: SparkSession,
    path: str,
    *,
    member: str = EXPORT_MEMBER,
    keep_time: bool = False,
    on_error: str = "raise",
    opener: Opener = open_file,
) -> DataFrame:
    """The same from zip archives that hold the export.

    ``member`` may be a pattern with ``*``, ``?`` or ``[]``, for archives with
    several exports; an archive without any raises.  Archives of any size:
    each one's table of contents is read first, then each member is unpacked
    as a stream by one task.  ``opener`` is how an executor opens a path.
    """
    return _chunk_records(zip_chunks(spark, path, member, opener), keep_time, on_error)


def zip_chunks(spark: SparkSession, path: str, member: str, opener: Opener = open_file) -> DataFrame:
    """(source, chunk) of the members, unpacked by as many tasks as there are members to share out."""
    # Only the listing of the files is read, not what is in them.
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = archives.mapInPandas(lambda batches: _members(batches, member, opener), "source string, member string, packed long")
    members, packed = found.agg(F.count("*"), F.sum("packed")).first()
    # Names alone are moved.
    tasks = max(1, min(members, max(spark.sparkContext.defaultParallelism, (packed or 0) // _PACKED_PER_TASK)))
    shared = found.repartition(tasks, F.xxhash64("source", "member"))
    return shared.mapInPandas(lambda batches: _unpack_members(batches, opener), "source string, chunk string")


def _members(batches: Iterator[pd.DataFrame], member: str, opener: Opener) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with opener(path) as file, zipfile.ZipFile(file) as archive:
                found = [i for i in archive.infolist() if i.filename == member or fnmatchcase(i.filename, member)]
            if not found:
                raise KeyError(f"no member {member!r} in {path}")
            sizes = [i.compress_size for i in found]
            yield pd.DataFrame({"source": path, "member": [i.filename for i in found], "packed": sizes})


def _unpack_members(batches: Iterator[pd.DataFrame], opener: Opener) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, member in zip(batch["source"], batch["member"]):
            with opener(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as packed:
                for chunk in _whole_records(io.TextIOWrapper(packed, "utf-8")):
                    yield pd.DataFrame({"source": [path], "chunk": [chunk]})


def parse_archives(
    archives: DataFrame, *, member: str = EXPORT_MEMBER, keep_time: bool = False, on_error: str = "raise"
) -> DataFrame:
    """The same from a table (source, content) of archives, of up to 2 GB each.

    Unpacking streams each archive in one task, since a zip member cannot be
    split, and hands on pieces of about a megabyte; those are spread out
    before the records are parsed.
    """
    chunks = archives.select("source", "content").mapInPandas(
        lambda batches: _unpack(batches, member), "source string, chunk string"
    )
    return _chunk_records(chunks, keep_time, on_error)


def _chunk_records(chunks: DataFrame, keep_time: bool, on_error: str) -> DataFrame:
    pieces = chunks.hint("rebalance").select("source", F.explode(F.split("chunk", RECORD)).alias("piece"))
    return parse_records(pieces, keep_time=keep_time, on_error=on_error)


def _unpack(batches: Iterator[pd.DataFrame], member: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["source"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as packed:
                for chunk in _whole_records(io.TextIOWrapper(packed, "utf-8")):
                    yield pd.DataFrame({"source": [path], "chunk": [chunk]})


def _whole_records(text: io.TextIOBase) -> Iterator[str]:
    """Pieces of the text, cut only in front of a record.

    Once the last start tag of a piece is closed, what follows up to the next
    record says nothing and is let go, so no more than a block and a tag are
    held.
    """
    held = ""
    while block := text.read(_CHUNK_CHARS):
        held += block
        cut = held.rfind(RECORD)
        if cut > 0:
            yield held[:cut]
            held = held[cut:]
        if tag := _OPEN_TAG.match(held):
            yield tag[0]
            held = held[tag.end() :]
            cut = -1
        if cut < 0:
            held = held[-len(RECORD) + 1 :]
        elif len(held) > MAX_TAG_CHARS:
            raise ValueError(f"a start tag of more than {MAX_TAG_CHARS} characters")


def parse_records(pieces: DataFrame, *, keep_time: bool = False, on_error: str = "raise") -> DataFrame:
    """``pieces``: (source, piece), each piece starting right after ``<Record``."""
    tag = F.regexp_replace(F.regexp_extract("piece", _START_TAG, 1), "/$", "")
    kept = pieces.filter(F.col("piece").rlike(r"^\s") & F.col("piece").contains(TYPE_PREFIX))
    record = F.from_xml(F.concat(F.lit(RECORD), tag, F.lit("/>")), _ATTRIBUTES, {"mode": "FAILFAST"})
    names = [TYPE_PREFIX + name for name in KEPT_TYPES]
    parsed = kept.select("source", record.alias("r")).filter(F.col("r._type").isin(names))
    number = F.col("r._value").cast("double") if on_error == "raise" else F.col("r._value").try_cast("double")
    columns = [
        "source",
        # The day as written: the local date of the device, whatever its offset.
        F.to_date(F.substring("r._startDate", 1, 10)).alias("dt"),
        metric_name(F.col("r._type")).alias("metric"),
        F.col("r._unit").alias("unit"),
        number.alias("value"),
    ]
    if keep_time:
        columns.append(F.col("r._startDate").alias("started"))
    return parsed.select(*columns)


def metric_name(record_type: Column) -> Column:
    return F.lower(F.replace(record_type, F.lit(TYPE_PREFIX), F.lit("")))
