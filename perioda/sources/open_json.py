"""Day payloads with whatever fields they hold: names and types are learned from the documents.

Documents are parsed once, into variants, and the activities in them are
written.  One aggregate over these finds the union of all keys at all depths,
and each leaf becomes a column with a dotted name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from perioda.schemas import RAW_ACTIVITY
from perioda.session import written
from perioda.sources.json import activity_columns

#: Keys that are data (dates, ids) rather than names make columns without end; more leaves than this raise.
MAX_FIELDS = 2000

Path = tuple[str, ...]


def read_open_activities(
    spark: SparkSession, path: str, *, multi_line: bool = False, max_fields: int = MAX_FIELDS
) -> DataFrame:
    """``day_activities`` of landed documents, with a column for every further leaf of an activity.

    One document a line, or a file (``multi_line``).  A further leaf is called
    by its keys, joined by dots; where names differ in case only, or an
    earlier column has the name, an underscore is added.  It is null where a
    document lacks it.  Whole numbers are bigint and others double; leaves of
    different kinds, and nulls everywhere, are text.  Lists stay lists.
    """
    lines = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    return open_activities(lines.select(F.parse_json("value").alias("doc")), "doc", max_fields=max_fields)


def open_activities(documents: DataFrame, doc: str, *, max_fields: int = MAX_FIELDS) -> DataFrame:
    """The same for documents held as variants in a column."""
    inside = lambda place, kind: F.variant_get(doc, f"$.{place}", kind)
    days = documents.select(
        inside("subjectId", "bigint").alias("subject_id"),
        (F.size(inside("AllDayHR.payload.heartRateValues", "array<variant>")) > 0).alias("has_pulse"),
        inside("ActivitiesForDay.payload", "array<variant>").alias("payload"),
    )
    found = written(days.select("subject_id", "has_pulse", F.explode("payload").alias("v")), "open-activities")
    declared = F.variant_get("v", "$", RAW_ACTIVITY.simpleString())
    learned = further_leaves(found, "v", RAW_ACTIVITY, max_fields=max_fields)
    columns = activity_columns(F.col("a"), {})
    taken = {name.lower() for name, _ in columns} | {"has_pulse"}
    further = []
    for keys, kind in learned:
        name = ".".join(keys)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        further.append(F.variant_get("v", json_path(keys), kind.simpleString()).alias(name))
    rows = found.select("subject_id", "has_pulse", declared.alias("a"), *further)
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns[3:]]
    return rows.select(*[value.alias(name) for name, value in columns], *kept, "has_pulse")


def further_leaves(rows: DataFrame, variant: str, known: T.StructType, *, max_fields: int = MAX_FIELDS) -> list[tuple[Path, T.DataType]]:
    """Leaves of a variant column beyond the ``known`` ones, in the order of their names."""
    text = rows.agg(F.schema_of_variant_agg(variant)).first()[0]
    kind = _parsed(text or "VOID")
    if not isinstance(kind, T.StructType):
        return []
    declared = {path for path, _ in leaves(known)}
    found = sorted(((path, plain(leaf)) for path, leaf in leaves(kind) if path not in declared), key=lambda leaf: leaf[0])
    if len(found) > max_fields:
        raise ValueError(f"{len(found)} further fields, {max_fields} at most; are keys of the payload data?")
    return found


def _parsed(text: str) -> T.DataType:
    """Type of a variant's schema, whose objects are written in another way; names in back quotes stay."""
    parts = re.split(r"(`(?:[^`]|``)*`)", text)
    return T._parse_datatype_string("".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in parts))


def leaves(kind: T.StructType, above: Path = ()) -> Iterator[tuple[Path, T.DataType]]:
    for field in kind:
        if isinstance(field.dataType, T.StructType) and len(field.dataType):
            yield from leaves(field.dataType, (*above, field.name))
        else:
            yield (*above, field.name), field.dataType


def plain(kind: T.DataType) -> T.DataType:
    """The column type of a leaf: JSON knows no decimals, and what has no one type is text."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, (T.NullType, T.VariantType)) or kind == T.StructType([]):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in kind])
    return kind


def json_path(keys: Path) -> str:
    """Path of a leaf; keys are quoted, so they may hold dots and blanks."""
    steps = []
    for key in keys:
        quote = "'" if "'" not in key else '"'
        if quote in key:
            raise ValueError(f"a key with both kinds of quotes: {key}")
        steps.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(steps)
