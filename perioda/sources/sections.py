"""The exercise-log section of a sectioned text export.

The section starts after a line that contains the marker and one more line,
has a CSV heading, and ends at a line that starts with ``#`` or has at most
one character, or at the end of the text.  A quoted cell may go on over line
ends; the heading may not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from perioda.operators.ordered import MAX_BROADCAST_BYTES
from perioda.session import written
from perioda.sources.html import named_cell

# Section marker and the columns read from it.
MARKER = "EXERCISE LOGS"
LOG_COLUMNS = {"mydate": "dt", "ename": "exercise", "record": "rep_max", "logs": "sets"}

MAX_TEXT_BYTES = 64 << 20
# What the lines of a text end with; the line reader of large files ends them alike.
_LINE_END = r"\r\n|\r|\n"
# Stand for a comma between cells and a line end between records while they are cut; no text has them.
_CUT, _NEXT = "\x00", "\x01"


def read_csv_sections(
    spark: SparkSession, path: str, *, max_text_bytes: int = MAX_TEXT_BYTES, on_error: str = "raise"
) -> DataFrame:
    """(source, dt, exercise, rep_max, sets) of all export files under ``path``.

    Files up to ``max_text_bytes`` are each one row; larger ones are read
    line by line in splits, so no file has to fit a task.  Which there are is
    known from the listing, without reading any.  Both ways end lines alike,
    and in both a quoted cell may hold line ends, which come out as ``\\n``.  A
    quote that is still open where its section ends raises.
    """
    size = F.col("_metadata.file_size")
    source = F.col("_metadata.file_path").alias("source")
    whole = spark.read.text(path, wholetext=True).filter(size <= max_text_bytes)
    small = parse_csv_sections(whole.select(source, F.col("value").alias("text")), ["source"], "text", on_error=on_error)

    large = spark.read.format("binaryFile").load(path).filter(F.col("length") > max_text_bytes)
    # A bound of each file is sent to all: its path and a place.
    found = large.agg(F.count("*").alias("files"), F.sum(F.octet_length("path") + 64).alias("bytes")).first()
    if not found["files"]:
        return small
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    # The filter is on the file size, which prunes the listing before any line is numbered.
    lines = spark.read.text(path).filter(size > max_text_bytes)
    lines = lines.select(source, place.alias("place"), F.col("value").alias("line"))
    section = _section_of_lines(lines, found["bytes"] <= MAX_BROADCAST_BYTES)
    return small.unionByName(_fields(_joined_records(section), ["source"], on_error))


def parse_csv_sections(texts: DataFrame, ids: Sequence[str], text: str, *, on_error: str = "raise") -> DataFrame:
    """The same for texts held in a column: one pass, no shuffle."""
    # No filters on the way: each would be pushed down and repeat the split below it.
    lines = texts.select(*ids, F.split(F.col(text), _LINE_END).alias("lines"))
    # Everything after the marker line and the one below it.
    marked = F.array_position(F.transform("lines", lambda line: line.contains(MARKER)), F.lit(True))
    rest = F.when(marked > 0, F.slice("lines", (marked + 2).cast("int"), F.size("lines")))
    body = lines.select(*ids, rest.alias("body"))
    end = F.array_position(F.transform("body", _ends), F.lit(True))
    inside = F.when(end > 0, F.slice("body", 1, (end - 1).cast("int"))).otherwise(F.col("body"))
    section = body.select(*ids, inside.alias("section"))
    # The heading is taken before the lines are spread, or each line would carry its whole section.
    body = _records_of(F.slice("section", 2, F.size("section")))
    headed = section.select(*ids, csv_cells(F.get("section", 0)).alias("head"), body.alias("lines"))
    rows = headed.select(*ids, "head", F.explode_outer("lines").alias("line")).filter(F.col("line").isNotNull())
    return _fields(rows, ids, on_error)


def _ends(line: Column) -> Column:
    return line.startswith("#") | (F.length(line) <= 1)


def _section_of_lines(lines: DataFrame, few: bool) -> DataFrame:
    """(source, head, line) from (source, place, line).

    One pass notes, per file, where its marker, the two lines after it and the
    end are.  All of those lie at or behind the marker, so a file's first
    marker is found first, then the three places behind it together.  With few
    files the notes are broadcast, and the lines stay where they are.
    """
    note = F.broadcast if few else lambda rows: rows
    is_marker = F.col("line").contains(MARKER)
    markers = _firsts(lines.filter(is_marker), "__m", "__marker")
    behind = lines.join(note(markers), F.col("source") == F.col("__m")).filter(F.col("place") > F.col("__marker"))
    # The smallest two places: the line that is skipped and the heading, unless the section ends there.
    behind = behind.drop("__m", "__marker")
    firsts = _firsts(behind, "__f", "__skipped")
    body = behind.join(note(firsts), F.col("source") == F.col("__f")).filter(F.col("place") > F.col("__skipped"))
    body = body.drop("__f", "__skipped")
    heads, ends = _firsts(body, "__h", "__head"), _firsts(body.filter(_ends(F.col("line"))), "__e", "__end")
    heads = body.join(note(heads), F.col("source") == F.col("__h")).filter(F.col("place") == F.col("__head"))
    heads = heads.select(F.col("source").alias("__b"), csv_cells(F.col("line")).alias("head"), "__head")
    marks = heads.join(ends, F.col("__b") == F.col("__e"), "left").drop("__e")
    inside = body.join(note(written(marks, "section-marks")), F.col("source") == F.col("__b"))
    inside = inside.filter(
        (F.col("place") > F.col("__head")) & (F.col("__end").isNull() | (F.col("place") < F.col("__end")))
    )
    return inside.select("source", "head", "place", "line")


def _firsts(lines: DataFrame, source: str, place: str) -> DataFrame:
    """The first place of each source; of each split first, by its number alone, which needs no sort."""
    splits = lines.groupBy(F.col("source").alias(source), F.col("place.start").alias("start")).agg(F.min("place.row").alias("row"))
    return splits.groupBy(source).agg(F.min(F.struct("start", "row")).alias(place))


def _odd_quotes(line: Column) -> Column:
    """1 if the line opens a quote without closing it, or the other way round."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def _records_of(lines: Column) -> Column:
    """Lines of one text -> records: a line end between quotes is part of a cell."""
    outside = lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit("\n"), F.lit(_NEXT))).otherwise(part)
    text = F.array_join(lines, "\n")
    records = F.split(F.array_join(F.transform(F.split(text, '"'), outside), '"'), _NEXT)
    open_ = F.aggregate(lines, F.lit(0), lambda n, line: (n + _odd_quotes(line)) % 2) == 1
    joined = F.when(open_, F.raise_error(F.lit("a quoted cell is not closed in its section"))).otherwise(records)
    # Most texts have no such line; those stay as they are.
    return F.when(F.exists(lines, lambda line: _odd_quotes(line) == 1), joined).otherwise(lines)


def _joined_records(section: DataFrame) -> DataFrame:
    """(source, head, line) from (source, head, place, line), lines of one record joined.

    Whether a line starts inside quotes depends on all lines before it.  Each
    split of a file is looked at by itself: it notes how many records start
    in it, both for a start outside and for one inside quotes, and whether it
    changes the state.  These notes, one a split, are composed in the order
    of the splits; then every split numbers its records from the right state.
    Only lines of records with several lines are moved.
    """
    lines = section.select("source", "head", F.col("place.start").alias("start"), F.col("place.row").alias("row"), "line")
    lines = written(lines.withColumn("odd", _odd_quotes(F.col("line"))), "section-lines")
    if lines.filter("odd = 1").isEmpty():
        return lines.select("source", "head", "line")
    split = Window.partitionBy("source", "start").orderBy("row")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    # Records so far, this line included, for both states that the split may start in.
    lines = lines.withColumns({"outs": F.sum(1 - F.col("inside")).over(split), "ins": F.sum("inside").over(split)})
    lines = written(lines, "section-states")
    notes = lines.groupBy("source", "start").agg(
        (F.sum("odd") % 2).alias("turns"), F.max("outs").alias("from_outside"), F.max("ins").alias("from_inside")
    )
    scan = Window.partitionBy("source").orderBy("start")
    earlier = scan.rowsBetween(Window.unboundedPreceding, -1)
    notes = notes.withColumn("state", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("state") == 0, F.col("from_outside")).otherwise(F.col("from_inside"))
    notes = notes.withColumn("base", F.coalesce(F.sum(starts).over(earlier), F.lit(0)))
    notes = written(notes.withColumn("end", (F.col("state") + F.col("turns")) % 2), "section-notes")
    open_ = notes.groupBy("source").agg(F.max_by("end", "start").alias("end")).filter("end = 1").first()
    if open_:
        raise ValueError(f"a quoted cell is not closed in its section: {open_['source']}")
    notes = notes.select(F.col("source").alias("of"), F.col("start").alias("at"), "state", "base")
    lines = lines.join(notes, (F.col("source") == F.col("of")) & (F.col("start") == F.col("at")))
    lines = lines.withColumn("inside", (F.col("inside") + F.col("state")) % 2)
    lines = lines.withColumn("record", F.col("base") + F.when(F.col("state") == 0, F.col("outs")).otherwise(F.col("ins")))
    several = (F.col("inside") == 1) | (F.col("odd") == 1)
    parts = lines.filter(several).groupBy("source", "record").agg(
        F.any_value("head").alias("head"), F.array_sort(F.collect_list(F.struct("start", "row", "line"))).alias("parts")
    )
    joined = parts.select("source", "head", F.array_join("parts.line", "\n").alias("line"))
    return lines.filter(~several).select("source", "head", "line").unionByName(joined)


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line; quotes are resolved, an empty cell is null.

    Between an even number of quotes a comma ends a cell.  A record with an odd
    number of them is not whole; it raises.
    """
    parts = F.split(line, '"')
    outside = lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(","), F.lit(_CUT))).otherwise(part)
    marked = F.array_join(F.transform(parts, outside), '"')
    closed = F.when(F.size(parts) % 2 == 1, marked).otherwise(
        F.raise_error(F.concat(F.lit("a quoted cell goes over the end of its line: "), F.left(line, F.lit(200))))
    )
    inner = lambda cell: F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    cell_of = lambda cell: F.when(cell.startswith('"'), inner(cell)).otherwise(F.nullif(cell, F.lit("")))
    return F.transform(F.split(F.when(line.isNotNull(), closed), _CUT), cell_of)


def _fields(rows: DataFrame, ids: Sequence[str], on_error: str) -> DataFrame:
    """Pick the wanted cells of ``line`` by the heading in ``head``."""
    parsed = rows.withColumn("cells", csv_cells(F.col("line")))
    picked = {name: named_cell(F.col("cells"), F.col("head"), title) for title, name in LOG_COLUMNS.items()}

    def to(value: Column, kind: str) -> Column:
        return value.cast(kind) if on_error == "raise" else value.try_cast(kind)

    return parsed.select(
        *ids,
        to(picked["dt"], "date").alias("dt"),
        picked["exercise"].alias("exercise"),
        to(picked["rep_max"], "float").alias("rep_max"),
        F.split(picked["sets"], ",").alias("sets"),
    )
