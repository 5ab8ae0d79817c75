"""Small helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

import perioda

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, as a file added to it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(perioda.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="perioda-"), f"perioda-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def arrow_function(kind: str) -> Callable:
    """``arrow_udf`` for functions that use this package."""
    ship_package(SparkSession.active())
    return F.arrow_udf(kind)


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column in ``taken`` has it.

    Spark compares names without case, so this does too.
    """
    seen = {name.lower() for name in taken}
    found = []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        found.append(name)
    return found


def as_text(name: str) -> Column:
    """The column as text; null counts as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def utf8(name: str) -> Column:
    """The column's UTF-8 bytes; null counts as the empty text."""
    return as_text(name).cast("binary")


def told_apart(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that hashes and orders can take and that keeps all differences.

    Hashes skip nulls at every depth and take -0.0 for 0.0, and neither they
    nor orders take maps.  So nulls are marked wherever they can be, arrays
    come with their size, floating numbers also as text, and maps as their
    entries, in the order they have.
    """
    null = value.isNull().alias("null")
    if isinstance(kind, T.ArrayType):
        return F.struct(null, F.size(value).alias("size"), F.transform(value, lambda x: told_apart(x, kind.elementType)).alias("of"))
    if isinstance(kind, T.StructType):
        fields = [told_apart(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]
        return F.struct(null, *fields)
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return told_apart(F.map_entries(value), T.ArrayType(entry))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.struct(null, value.alias("value"), value.cast("string").alias("text"))
    if isinstance(kind, T.VariantType):
        return F.struct(null, value.cast("string").alias("value"))
    return F.struct(null, value.alias("value"))


def row_marks(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes over all columns of a row that only equal rows share."""
    every = [told_apart(col(f.name), f.dataType) for f in df.schema]
    return F.xxhash64(*every), F.xxhash64(F.lit(1), *every)


def exploded(df: DataFrame, count: str, index: str, step: int = 4096) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``index``.

    Two steps, so that no array is longer than count / step or step.
    """
    (part,) = fresh([*df.columns, index], "__part")
    last = col(count) - 1
    parts = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {step}"))))
    inner = F.sequence(col(part) * step, F.least(last, col(part) * step + (step - 1)))
    return parts.withColumn(index, F.explode(inner)).drop(part)
