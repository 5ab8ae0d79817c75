"""Tables of immutable versions, for stores that cannot rename and for readers that must not be disturbed.

A table is a folder of data folders, none of which is ever changed, and of
small pointer files with rising numbers.  A pointer lists the data folders of
one version, by year, and ends with its own checksum.  A writer puts the new
data beside the old and, last of all, its pointer; a single file is either
there and whole or it does not count, so nothing has to be moved.  A reader
looks for the newest whole pointer once and then reads the folders it lists,
whatever is written meanwhile.  Old versions are removed by a call of their own.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from perioda.session import file_system, written_for_now
from perioda.sources.tables import YEAR, empty_table

DATA, POINTERS = "data", "pointers"


@dataclass(frozen=True)
class Version:
    """Number of a version, and its folders by year; a table without years has them under None."""

    number: int
    folders: tuple[tuple[int | None, str], ...]


EMPTY = Version(0, ())


def _pointer_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{POINTERS}/{number:020d}"


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, place = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(name) for name in _names(spark, f"{path.rstrip('/')}/{POINTERS}") if name.isdigit()]


def _pointer(spark: SparkSession, path: str, number: int) -> Version | None:
    """The version a pointer lists; None if its writer broke off, or it was removed meanwhile."""
    files, place = file_system(spark, _pointer_path(path, number))
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    body, _, check = text.rpartition("\n")
    if not body or check != str(zlib.crc32(body.encode())):
        return None
    return Version(number, tuple((year, folder) for year, folder in json.loads(body)))


def current_version(spark: SparkSession, path: str) -> Version:
    """The newest version whose pointer is whole; an empty one if there is none."""
    for number in reversed(_numbers(spark, path)):
        found = _pointer(spark, path, number)
        if found:
            return found
    return EMPTY


def _publish(spark: SparkSession, path: str, after: int, folders: Sequence[tuple[int | None, str]]) -> None:
    """Write the next pointer.  Numbers are not used twice, also not those of broken pointers."""
    number = max([after, *_numbers(spark, path)]) + 1
    if current_version(spark, path).number != after:
        raise RuntimeError(f"{path}: another writer has published a version since {after}")
    body = json.dumps(sorted(folders, key=lambda f: (f[0] is None, f)))
    files, place = file_system(spark, _pointer_path(path, number))
    stream = files.create(place, False)
    try:
        stream.write(bytearray(f"{body}\n{zlib.crc32(body.encode())}".encode()))
    finally:
        stream.close()


def _put(df: DataFrame, path: str, by_year: bool) -> list[tuple[int | None, str]]:
    """Write ``df`` to a new data folder and count it; the folders to list."""
    spark = df.sparkSession
    name = f"{DATA}/{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{name}"
    counted = Observation()
    even = df.hint("rebalance", YEAR) if by_year else df
    even.observe(counted, F.count("*").alias("rows")).write.partitionBy(*[YEAR] * by_year).parquet(folder)
    expected, found = counted.get["rows"], spark.read.schema(df.schema).parquet(folder).count()
    if expected != found:
        raise RuntimeError(f"{folder}: {found} rows written, {expected} expected")
    if not by_year:
        return [(None, name)]
    years = [n for n in _names(spark, folder) if n.startswith(f"{YEAR}=")]
    return [(int(n.partition("=")[2]), f"{name}/{n}") for n in years]


def read_version(
    spark: SparkSession, path: str, schema: T.StructType, *, version: Version | None = None, years: Collection[int] | None = None
) -> DataFrame:
    """The newest version, or the given one, or no rows if nothing was written yet.

    With ``years`` only their folders are read; the rest are not even listed.
    """
    version = version or current_version(spark, path)
    chosen = [f for year, f in version.folders if years is None or year is None or year in years]
    if not chosen:
        return empty_table(spark, schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in chosen])


def replace_version(df: DataFrame, path: str, *, column: str | None = None) -> None:
    """Publish ``df``, which may read the table itself, as the whole table; by the years of ``column`` if one is given."""
    spark = df.sparkSession
    before = current_version(spark, path)
    rows = df if column is None else df.withColumn(YEAR, F.coalesce(F.year(column), F.lit(0)))
    _publish(spark, path, before.number, _put(rows, path, column is not None))


def merge_version(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType,
    *,
    column: str = "dt",
) -> None:
    """Publish the table with a batch merged in; only the years of the batch are read and written.

    ``merge(existing, batch)`` must keep every date.  The other years' folders
    are listed again as they are.  A run that breaks off anywhere leaves the
    table as it was, and may simply be repeated.
    """
    before = current_version(spark, path)
    if any(year is None for year, _ in before.folders):
        raise ValueError(f"{path} was not written by years")
    year_of = F.coalesce(F.year(column), F.lit(0))
    with written_for_now(batch, "merge-batch") as once:
        years = {row[YEAR] for row in once.select(year_of.alias(YEAR)).distinct().collect()}
        if not years:
            return
        existing = read_version(spark, path, schema, version=before, years=years)
        merged = merge(existing, once).select(*schema.fieldNames()).withColumn(YEAR, year_of)
        new = _put(merged, path, True)
    _publish(spark, path, before.number, [*[f for f in before.folders if f[0] not in years], *new])


#: Column of a derived table that names the folder of the source its year was made from.
ORIGIN = "origin"


def refresh_derived(
    spark: SparkSession,
    source: str,
    derived: str,
    schema: T.StructType,
    make: Callable[[DataFrame], DataFrame],
    *,
    column: str = "dt",
) -> list[int]:
    """Bring the table at ``derived`` up to the newest version of ``source``; the years that were made anew.

    ``make`` turns rows of ``source`` into rows with a date in ``column``, each
    of them from rows of its own year.  Data folders never change, and every derived
    row names the folder its year was made from (``ORIGIN``), so the years whose folder is
    another one by now are all that a merge has touched: only these are read
    and made again.  Years that ``source`` has no more are left out.  A run
    that breaks off anywhere is simply repeated.
    """
    now, before = dict(current_version(spark, source).folders), current_version(spark, derived)
    if None in now:
        raise ValueError(f"{source} was not written by years")
    kept = list(before.folders)
    names = T.StructType([T.StructField(ORIGIN, T.StringType()), T.StructField(column, T.DateType())])
    made_from = {}
    if kept:
        recorded = read_version(spark, derived, names, version=before)
        recorded = recorded.select(F.coalesce(F.year(column), F.lit(0)).alias(YEAR), ORIGIN).distinct()
        made_from = {row[YEAR]: row[ORIGIN] for row in recorded.collect()}
    stale = sorted(year for year, folder in now.items() if made_from.get(year) != folder)
    kept = [f for f in kept if f[0] in now and f[0] not in stale]
    if not stale and len(kept) == len(before.folders):
        return []
    new = []
    if stale:
        year_of = F.coalesce(F.year(column), F.lit(0))
        origins = F.create_map(*[F.lit(part) for year in stale for part in (year, now[year])])
        version = Version(0, tuple((year, now[year]) for year in stale))
        rows = make(read_version(spark, source, schema, version=version)).withColumn(YEAR, year_of)
        new = _put(rows.withColumn(ORIGIN, origins[F.col(YEAR)]), derived, True)
    _publish(spark, derived, before.number, [*kept, *new])
    return stale


def remove_old_versions(spark: SparkSession, path: str, *, keep: int = 2, grace_seconds: float = 86_400) -> int:
    """Remove all but the newest ``keep`` versions, and data no kept one lists; the number of data folders removed.

    Pointers and data younger than ``grace_seconds`` stay, as a reader may
    still be busy with the one and a writer with the other.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    border = (time.time() - grace_seconds) * 1000
    whole = [v for v in (_pointer(spark, path, n) for n in _numbers(spark, path)) if v]
    files, _ = file_system(spark, path)
    old = lambda place: files.getFileStatus(place).getModificationTime() <= border
    listed = set()
    for k, version in enumerate(reversed(whole)):
        place = file_system(spark, _pointer_path(path, version.number))[1]
        if k >= keep and old(place):
            files.delete(place, False)
        else:
            listed |= {folder.split("/")[1] for _, folder in version.folders}
    removed = 0
    for name in _names(spark, f"{path.rstrip('/')}/{DATA}"):
        place = file_system(spark, f"{path.rstrip('/')}/{DATA}/{name}")[1]
        if name not in listed and old(place):
            files.delete(place, True)
            removed += 1
    return removed
