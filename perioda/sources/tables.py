"""Parquet tables: read, load or start empty, replace, merge a batch in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from perioda.session import file_system, written_for_now

YEAR = "year"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan of a table; works for local, HDFS and object-store addresses alike.

    With a schema nothing is inferred and a partition column outside it is
    left out.
    """
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows with the same columns if nothing is there yet."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


# A marker's name says what of the table the staged copy replaces.  Spark does not read such files.
WHOLE, PARTITIONS = "_replaces_table", "_replaces_partitions"


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}__{what}"


def _years(df: DataFrame, year: Column) -> list[int]:
    """The years in ``df``: no more values than the calendar has."""
    return [row[YEAR] for row in df.select(year.alias(YEAR)).distinct().collect()]


def _stage(df: DataFrame, path: str, partition_by: Sequence[str], marker: str) -> None:
    """Write a full copy beside the table, and say so when all its rows are there."""
    # REBALANCE gives files of even size and splits a hot partition over many.
    even = df.hint("rebalance", *partition_by) if partition_by else df
    counted = Observation()
    staging = _beside(path, "staging")
    even.observe(counted, F.count("*").alias("rows")).write.partitionBy(*partition_by).parquet(staging)
    expected, found = counted.get["rows"], read_table(df.sparkSession, staging, df.schema).count()
    if expected != found:
        raise RuntimeError(f"{staging}: {found} rows written, {expected} expected")
    files, place = file_system(df.sparkSession, f"{staging}/{marker}")
    files.create(place, True).close()


def _move(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def finish_swap(spark: SparkSession, path: str) -> None:
    """Finish or discard what a broken replace or merge has left.

    Up to the marker the table is as it was, and the unfinished copy goes.
    From the marker on, every folder is moved by a rename, the live one out
    before the staged one in; whatever was moved already is not moved again.
    """
    files, live = file_system(spark, path)
    _, staging = file_system(spark, _beside(path, "staging"))
    _, old = file_system(spark, _beside(path, "old"))
    marked = lambda name: files.exists(file_system(spark, f"{_beside(path, 'staging')}/{name}")[1])
    if marked(WHOLE):
        if files.exists(live):
            files.delete(old, True)
            _move(files, live, old)
        _move(files, staging, live)
    elif marked(PARTITIONS):
        files.mkdirs(live)
        files.mkdirs(old)
        for status in files.listStatus(staging):
            name = status.getPath().getName()
            if "=" not in name:
                continue
            _, target = file_system(spark, f"{path.rstrip('/')}/{name}")
            if files.exists(target):
                _, aside = file_system(spark, f"{_beside(path, 'old')}/{name}")
                files.delete(aside, True)
                _move(files, target, aside)
            _move(files, status.getPath(), target)
    files.delete(staging, True)
    if files.exists(live):
        files.delete(old, True)
    spark.catalog.refreshByPath(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``, which ``df`` may itself read.

    The new rows are written in full beside the table and counted, then moved
    into place by renames.  A run that breaks off anywhere loses nothing: the
    next replace or merge of the table, or ``finish_swap``, finishes it or
    leaves the table as it was.  Renames have to be atomic, as those of HDFS
    and local disks are.
    """
    finish_swap(df.sparkSession, path)
    _stage(df, path, partition_by, WHOLE)
    finish_swap(df.sparkSession, path)


def merge_into_table(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType,
    *,
    column: str = "dt",
) -> None:
    """Merge a batch into a table partitioned by year.

    Only the years the batch touches are read, merged and rewritten.
    ``merge(existing, batch)`` must keep every date, as the merges of this
    library do.  The batch is evaluated once.  As ``replace_table`` does, a
    merge that is run again after a failure loses nothing.
    """
    finish_swap(spark, path)
    with_year = T.StructType([*schema.fields, T.StructField(YEAR, T.IntegerType(), True)])
    year_of = F.coalesce(F.year(column), F.lit(0))
    with written_for_now(batch, "merge-batch") as once:
        years = _years(once, year_of)
        if not years:
            return
        existing = load_or_empty(spark, path, with_year).filter(F.col(YEAR).isin(years)).drop(YEAR)
        merged = merge(existing, once).select(*schema.fieldNames()).withColumn(YEAR, year_of)
        _stage(merged, path, [YEAR], PARTITIONS)
    finish_swap(spark, path)
