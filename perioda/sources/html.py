"""Rows out of HTML pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Closing tags may be left out: a row ends where the next one starts, and so does a cell.
_TABLE = r"(?is)<table\b"
_LAST_TABLE = r"(?is)^.*<table\b[^>]*>(.*?)(?:</table\b|\z)"
_COMMENT = r"(?s)<!--.*?-->"
_ROW_START = r"(?i)<tr\b[^>]*>"
_CELL_START = r"(?i)<t[hd]\b[^>]*>"
_CELL_TAG = r"(?i)<t[hd]\b"
_SPANS = r"(?i)<t[hd]\b[^>]*\b(row|col)span"
#: Standard limits of the two spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534
_CELL_END, _END = r"(?i)</(?:t[hdr]|thead|tbody|tfoot)\b", "</td "
_SPACES = r"[\s\xa0]{2,}|[\t\n\x0B\f\r\xa0]"
_ITEM = r'(?is)<li\b[^>]*>\s*<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'

# Named entities as Python's standard library lists them, in one literal: pairs end with one sign, names with another.
_PAIR, _NAME = "\x01", "\x02"
_NAMED = _PAIR.join(f"{name}{_NAME}{chr(code)}" for name, code in name2codepoint.items())


def _unescaped(piece: Column) -> Column:
    """A piece that followed an ampersand, with the entity it starts with resolved."""
    inside = F.substring_index(piece, ";", 1)
    rest = F.substring(piece, F.length(inside) + 2, F.length(piece))
    named = F.try_element_at(F.str_to_map(F.lit(_NAMED), F.lit(_PAIR), F.lit(_NAME)), inside)
    decimal = F.regexp_extract(inside, "^#([0-9]{1,7})$", 1).try_cast("int")
    hexadecimal = F.nullif(F.regexp_extract(inside, "^#[xX]([0-9a-fA-F]{1,6})$", 1), F.lit(""))
    code = F.coalesce(decimal, F.conv(hexadecimal, 16, 10).try_cast("int"))
    real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    letter = F.coalesce(named, F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
    closed = F.contains(piece, F.lit(";"))
    return F.when(closed & letter.isNotNull(), F.concat(letter, rest)).otherwise(F.concat(F.lit("&"), piece))


def plain_text(markup: Column) -> Column:
    """Text of a cell: tags dropped, entities resolved, white space as one space, ends trimmed."""
    bare = F.regexp_replace(markup, r"(?s)<[^>]*>", "")
    pieces = F.transform(F.split(bare, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_unescaped(piece)))
    # Most cells have no entity; those are not taken apart.
    resolved = F.when(F.contains(bare, F.lit("&")), F.array_join(pieces, "")).otherwise(bare)
    return F.trim(F.regexp_replace(resolved, r"[\s\xa0]+", " "))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def read_html_tables(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Last table of each page file; ``columns`` maps heading to column."""
    pages = spark.read.text(path, wholetext=True)
    pages = pages.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("html"))
    return html_table(pages, ["source"], "html", columns)


def _span(attributes: Column, name: str, limit: int) -> Column:
    """Value of a span attribute: 1 if there is none, if it is 0, or if it is no number."""
    found = F.regexp_extract(attributes, rf"""(?i)(?:^|\s){name}\s*=\s*["']?\s*([0-9]+)""", 1)
    value = F.coalesce(found.try_cast("int"), F.when(found != "", limit), F.lit(1))
    return F.least(F.greatest(value, F.lit(1)), F.lit(limit))


def _texts(cells: Column) -> Column:
    """Texts of cells of a table in which ``_prepared`` has been; most have no markup, and need no pattern."""
    bodies = F.transform(cells, lambda cell: F.substring_index(cell, _END, 1))
    marked = lambda body: F.contains(body, F.lit("<")) | F.contains(body, F.lit("&"))
    return F.transform(bodies, lambda body: F.when(marked(body), plain_text(body)).otherwise(F.trim(body)))


def _prepared(table: Column) -> Column:
    """White space as single spaces, and all that ends a cell as ``_END``, which nothing else is then."""
    return F.regexp_replace(F.regexp_replace(table, _SPACES, " "), _CELL_END, _END)


def _columns_of(row: Column) -> Column:
    """A row's own columns in order: (key, kind, idx, text, left).

    A cell is as many columns as it is wide; ``key`` is where the first of
    them stands if nothing reaches down from above, and ``left`` how many
    rows further down it reaches.
    """
    pieces = F.filter(F.split(row, _CELL_TAG), lambda _, i: i > 0)
    attributes = F.transform(pieces, lambda piece: F.substring_index(piece, ">", 1))
    # One column per piece without its start tag.
    bodies = F.transform(pieces, lambda piece: F.when(F.contains(piece, F.lit(">")), F.substring(piece, F.locate(">", piece) + 1, F.length(piece))).otherwise(""))
    cells = F.arrays_zip(attributes.alias("attributes"), _texts(bodies).alias("text"))

    def units(cell: Column) -> Column:
        plain = F.array(F.struct(F.lit(0).alias("k"), cell["text"].alias("text"), F.lit(0).alias("left")))
        down = _span(cell["attributes"], "rowspan", MAX_ROWSPAN) - 1
        wide = F.transform(
            F.sequence(F.lit(0), _span(cell["attributes"], "colspan", MAX_COLSPAN) - 1),
            lambda k: F.struct(k.alias("k"), cell["text"].alias("text"), down.alias("left")),
        )
        return F.when(F.contains(F.lower(cell["attributes"]), F.lit("span")), wide).otherwise(plain)

    return F.transform(
        F.flatten(F.transform(cells, units)),
        lambda unit, i: F.struct((i - unit["k"]).alias("key"), F.lit(1).alias("kind"), i.alias("idx"), unit["text"].alias("text"), unit["left"].alias("left")),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a column used twice in a lambda is computed twice."""
    return F.get(F.transform(F.array(value), body), 0)


_HELD = "array<struct<at: int, text: string, left: int>>"


def _laid_out(rows: Column) -> Column:
    """Rows of own columns -> rows of texts, every cell repeated wherever it reaches.

    A fold over the rows.  Its state is the list of columns that reach further
    down, in order.  The k-th of them stands before a row's own cell if its
    place, less k, is no larger than the widths of the row's cells before that
    one; so one sort by these keys puts both in order.  What reaches beyond
    the last row makes rows of its own.
    """
    none = F.array().cast(_HELD)

    def lay(state: Column, row: Column) -> Column:
        above = F.transform(
            state["held"],
            lambda held, k: F.struct((held["at"] - k).alias("key"), F.lit(0).alias("kind"), k.alias("idx"), held["text"].alias("text"), (held["left"] - 1).alias("left")),
        )
        line = F.when(F.size(state["held"]) == 0, row).otherwise(F.array_sort(F.concat(above, row)))

        def put(line: Column) -> Column:
            placed = F.transform(line, lambda column, i: F.struct(i.alias("at"), column["text"].alias("text"), column["left"].alias("left")))
            below = F.filter(placed, lambda column: column["left"] > 0)
            return F.struct(F.concat(state["rows"], F.array(line["text"])).alias("rows"), below.alias("held"))

        return _let(line, put)

    def rest(state: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(state["held"], lambda held: held["left"])), F.lit(0))
        steps = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
        behind = F.transform(
            steps, lambda k: F.transform(F.filter(state["held"], lambda held: held["left"] >= k), lambda held: held["text"])
        )
        return F.concat(state["rows"], behind)

    empty = F.struct(F.array().cast("array<array<string>>").alias("rows"), none.alias("held"))
    return F.aggregate(rows, empty, lay, rest)


def html_table(pages: DataFrame, ids: Sequence[str], html: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows of the last table on each page, all columns as text.

    The first row holds the headings; rows without a cell don't count.  A cell
    that spans rows or columns stands in each of them.  A
    page without a table, or with an empty one, gives no rows; a table that
    shows something in which no row can be read, or without one of the
    headings, raises.
    """
    # Each step is a column of its own: a pattern in an expression that is used twice runs twice over the page.
    table = F.regexp_replace(F.regexp_extract(html, _LAST_TABLE, 1), _COMMENT, "").alias("table")
    tables = pages.select(*ids, F.col(html).rlike(_TABLE).alias("has_table"), table)
    tables = tables.select(*ids, "has_table", "table", _prepared(F.col("table")).alias("clean"))
    cells_of = lambda row: _texts(F.filter(F.split(row, _CELL_START), lambda _, i: i > 0))
    simple = F.filter(F.transform(F.split("clean", _ROW_START), cells_of), lambda cells: F.size(cells) > 0)
    spanned = F.filter(F.transform(F.split("clean", _ROW_START), _columns_of), lambda columns: F.size(columns) > 0)
    # Only tables with spans go through the fold.
    found = F.when(F.col("table").rlike(_SPANS), _laid_out(spanned)).otherwise(simple)
    shown = F.regexp_replace("table", r"(?s)<[^>]*>|\s", "") != ""
    unread = F.col("has_table") & ~F.col("table").rlike(_CELL_START) & shown
    rows = F.when(unread, F.raise_error(F.lit("a table in which no row can be read"))).otherwise(found)
    tables = tables.select(*ids, rows.alias("rows"))
    # The headings are taken before the rows are spread, or each row would carry its whole table.
    headed = tables.select(*ids, F.get("rows", 0).alias("head"), F.slice("rows", 2, F.size("rows")).alias("body"))
    # An outer explode, since a plain one filters on the size and would parse the page twice.
    split = headed.select(*ids, "head", F.explode_outer("body").alias("cells")).filter(F.col("cells").isNotNull())
    return split.select(
        *ids, *[named_cell(F.col("cells"), F.col("head"), title).alias(name) for title, name in columns.items()]
    )


def named_cell(cells: Column, head: Column, title: str) -> Column:
    """Cell under the heading ``title``; null if the row is too short."""
    place = F.array_position(head, title)
    return F.when(
        place > 0, F.try_element_at(cells, F.when(place > 0, place).otherwise(F.lit(1)).cast("int"))
    ).otherwise(F.raise_error(F.lit(f"no column {title!r}")))


def number(text: Column) -> Column:
    """Number of a cell; a comma separates thousands, anything else is null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def html_items(pages: DataFrame, ids: Sequence[str], html: str) -> DataFrame:
    """(ids, item, href, label) of every linked list item, in page order."""
    pairs = F.arrays_zip(_all(F.col(html), _ITEM, 1).alias("href"), _all(F.col(html), _ITEM, 2).alias("label"))
    items = pages.select(*ids, F.posexplode(pairs).alias("item", "pair"))
    return items.select(
        *ids, F.col("item").cast("bigint").alias("item"), F.col("pair.href").alias("href"),
        plain_text(F.col("pair.label")).alias("label"),
    )
