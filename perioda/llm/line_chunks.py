"""Removal of multi-line passages that many documents share.

From every line that holds a word a chunk runs to the first border behind it,
and to every such line one runs from the last border before it.  A hash rolled
over the lines at that end of the chunk says whether there is a border, so a
chunk depends on its own lines alone and is cut alike wherever they stand, up
to both ends of a passage.  Chunks that stand anywhere before are removed,
after their bytes have been compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, as_text, col, fresh, utf8
from perioda.session import written

#: Lines the rolling hash sees, and one of how many of its values is no border.
WINDOW = 2
DIVISOR = 8
MIN_LINES = 2
#: Where no border came, one stands behind so many lines (repeated lines all have one hash).
MAX_LINES = 8
#: A line of so many words is a chunk of its own, too.
LONG_LINE_WORDS = 50
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_MARK = "array<struct<at: int, end: int, high: long, low: long>>"
_MARK_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))


@dataclass(frozen=True)
class Cutting:
    window: int = WINDOW
    divisor: int = DIVISOR
    min_lines: int = MIN_LINES
    max_lines: int = MAX_LINES
    long_line_words: int = LONG_LINE_WORDS

    def __post_init__(self) -> None:
        if not 1 <= self.window <= self.min_lines <= self.max_lines:
            raise ValueError("a chunk's borders have to depend on its own lines: window <= min_lines <= max_lines")


def borders(lines: list[bytes], cutting: Cutting) -> list[int]:
    """The rolling hash of the ``window`` lines that end at each line; fewer at the start."""
    power = pow(_PRIME, cutting.window, 1 << 64)
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    rolling, found = 0, []
    for i, own in enumerate(hashes):
        rolling = (rolling * _PRIME + own) & _MASK
        if i >= cutting.window:
            rolling = (rolling - hashes[i - cutting.window] * power) & _MASK
        found.append(rolling)
    return found


def chunks(lines: list[bytes], cutting: Cutting) -> list[tuple[int, int]]:
    """(first line, line behind the last) of all chunks, in order; they overlap."""
    words = [len(line.split()) for line in lines]
    own = [i for i, n in enumerate(words) if n]
    rolled = borders([lines[i] for i in own], cutting)
    # Two parts of a hash, for borders behind its lines and in front of them.
    behind = [(h >> 32) % cutting.divisor > 0 for h in rolled]
    before = [(h & 0xFFFFFFFF) % cutting.divisor > 0 for h in rolled[cutting.window - 1 :]]
    found = {(i, i + 1) for i in own if words[i] >= cutting.long_line_words}
    short, long = cutting.min_lines - 1, cutting.max_lines - 1
    for k in range(len(own) - short):
        end, stop = k + short, min(k + long, len(own) - 1)
        while end < stop and not behind[end]:
            end += 1
        found.add((own[k], own[end] + 1))
    for k in range(short, len(own)):
        start, stop = k - short, max(k - long, 0)
        while start > stop and not before[start]:
            start -= 1
        found.add((own[start], own[k] + 1))
    return sorted(found)


def marks_of(text: bytes, cutting: Cutting) -> list[dict[str, int]]:
    lines, found = text.split(b"\n"), []
    for at, end in chunks(lines, cutting):
        digest = xxhash.xxh3_128_digest(b"\n".join(lines[at:end]))
        high, low = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
        found.append({"at": at, "end": end, "high": high, "low": low})
    return found


def without(text: str, ranges: list[dict[str, int]] | None) -> tuple[str, int]:
    """The text without these ranges of lines, which may overlap, and how many lines went."""
    if not ranges:
        return text, 0
    lines, kept, done = text.encode().split(b"\n"), [], 0
    for at, end in sorted((r["at"], r["end"]) for r in ranges):
        kept += lines[done:at]
        done = max(done, end)
    kept += lines[done:]
    return b"\n".join(kept).decode(), len(lines) - len(kept)


def _marks(text: str, cutting: Cutting) -> Column:
    @arrow_function(_MARK)
    def marked(texts: pa.Array) -> pa.Array:
        return pa.array([marks_of(value.as_py(), cutting) for value in texts], _MARK_TYPE)

    return marked(utf8(text))


def _bytes(text: str, ranges: Column) -> Column:
    @arrow_function("array<struct<at: int, end: int, bytes: binary>>")
    def found(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = []
        for value, own in zip(texts, wanted):
            lines = value.as_py().split(b"\n")
            rows.append([{**r, "bytes": b"\n".join(lines[r["at"] : r["end"]])} for r in own.as_py()])
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("bytes", pa.binary())])))

    return found(utf8(text), ranges)


def remove_repeated(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cutting: Cutting = Cutting(), removed: str = "removed_lines"
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and the number of lines that went.

    A chunk has at least ``min_lines`` lines that hold a word, or is one line
    of ``long_line_words`` words.  A line goes if a chunk with it stands, with
    the same bytes, at a place before: at a smaller doc_id (null first), then a
    smaller hash of the text, then an earlier line.  So of equal lines the one
    in the first place of all is never cut.  A shared passage of two lines is
    one chunk unless both its borders fail, one time in ``divisor`` squared;
    of longer ones more chunks would have to fail.  Lines without a word go
    only between lines of a chunk.  Rows with equal doc_id and equal text are
    one document and fare alike.  Lines end at a line feed and nowhere else.
    Null texts stay null; an empty text has no chunk.  Rows and other columns
    stay; a column that has the new name keeps it, and the new one gets an
    underscore.
    """
    (lines_gone,) = fresh(docs.columns, removed)
    taken = [*docs.columns, lines_gone]
    print_, ranges, state, g_doc, g_print = fresh(taken, "__print", "__ranges", "__cleaned", "__doc_", "__print_")
    rows = docs.select(col(doc_id).alias("doc"), F.xxhash64(as_text(text)).alias("print"), col(text).alias("text"))
    marks = rows.select("doc", "print", F.explode(_marks("text", cutting)).alias("m"))
    marks = written(marks.select("doc", "print", "m.at", "m.end", "m.high", "m.low"), "chunk-marks")

    # Compact digests first: only chunks that occur twice have their bytes moved.
    place = F.struct("doc", "print", "at")
    again = marks.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = again.filter("first < last").select("high", "low")
    hit = marks.join(again, ["high", "low"])
    wanted = hit.groupBy("doc", "print").agg(F.collect_set(F.struct("at", "end")).alias("ranges"))
    same = lambda a, b: (a["doc"].eqNullSafe(b["doc"])) & (a["print"] == b["print"])
    found = rows.join(wanted, same(rows, wanted)).select(
        rows["doc"], rows["print"], F.explode(_bytes("text", F.col("ranges"))).alias("c")
    )
    found = written(
        found.select("doc", "print", "c.at", "c.end", "c.bytes", F.xxhash64("c.bytes").alias("digest")), "chunk-bytes"
    )

    # Grouping by the bytes themselves compares them.
    firsts = found.groupBy("digest", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter("first < last").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first")
    # Written, so that the join is not bound to the grouping's partitions and a frequent chunk can be split.
    firsts = written(firsts, "chunk-firsts")
    extra = found.join(firsts, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b"))).filter(place > F.col("first"))
    gone = extra.groupBy("doc", "print").agg(F.collect_set(F.struct("at", "end")).alias(ranges))
    gone = gone.withColumnsRenamed({"doc": g_doc, "print": g_print})

    marked = docs.withColumn(print_, F.xxhash64(as_text(text)))
    joined = marked.join(gone, col(doc_id).eqNullSafe(col(g_doc)) & (col(print_) == col(g_print)), "left")

    @arrow_function("text string, gone long")
    def cleaned(texts: pa.Array, cut: pa.Array) -> pa.Array:
        pairs = [(None, 0) if t is None else without(t, r) for t, r in zip(texts.to_pylist(), cut.to_pylist())]
        kept, counts = zip(*pairs) if pairs else ((), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.int64())], ["text", "gone"])

    joined = joined.withColumn(state, cleaned(col(text).cast("string"), col(ranges)))
    return joined.select(
        *[col(state)["text"].alias(c) if c == text else col(c) for c in docs.columns],
        col(state)["gone"].alias(lines_gone),
    )
