"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE sizes the shuffles and splits skewed join partitions; results are
# calendar dates, so the zone is pinned.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Noting the Python line of every column costs more than planning a small report.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "perioda", **overrides: str) -> SparkSession:
    """Session with the library's settings; master and sizes come from the submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="perioda-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop objects of the session's JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is put there goes with the session."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint does, survives lost executors, and
    stays columnar, so later passes read only the columns they need.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_for_now(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``written``, removed again when the caller is done with it."""
    path = new_shared_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)
