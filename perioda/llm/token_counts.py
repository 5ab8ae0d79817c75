"""Token counts by the whole-token shortcut.

A text is cut into pre-tokens at places no vocabulary string can cross.  Which
vocabulary strings encode alone as one token is proved once, by encoding every
one of them; pre-tokens among those count one each without any merging.  Only
the other pre-tokens go through the merges of the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perioda.llm.common import arrow_function, as_text, col, fresh

SPACE = "▁"
#: A line end, spaces with the word behind them, or a word at the start of a line.
UNIT = re.compile("\n| +[^ \n]*|[^ \n]+")
#: Units remembered per Python worker, and the longest one that is.
REMEMBERED_UNITS = 300_000
REMEMBERED_CHARS = 64


def model_of(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def cuts_are_safe(model: sentencepiece.SentencePieceProcessor) -> bool:
    """True if texts may be cut before a run of spaces and around line ends.

    A merge makes a vocabulary string, so it suffices that none of them has a
    space behind another character, or a line end beside one, and that the
    model leaves every character as it is but for the space sign.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in piece.lstrip(SPACE) or ("\n" in piece and len(piece) > 1) for piece in pieces):
        return False
    if not hasattr(model, "normalize"):
        return False
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    if model.normalize(every) != SPACE + every.replace(" ", SPACE):
        return False
    # Sequences that a normal form would join or a cleaner would squeeze.
    odd = "é Å 가  \t \n\n x "
    return model.normalize(odd) == SPACE + odd.replace(" ", SPACE) and len(model.encode("\n")) == 2


def count_unit(model: sentencepiece.SentencePieceProcessor, unit: str) -> int:
    """Tokens of one pre-token by the library itself.

    The library puts a space in front of what it gets.  A unit that starts
    with a space gives up its own; before any other one stands a line end,
    which makes two tokens with the added space.
    """
    if unit[0] == " ":
        return len(model.encode(unit[1:])) if unit != " " else 1
    return 1 if unit == "\n" else len(model.encode("\n" + unit)) - 2


def whole_tokens(model: sentencepiece.SentencePieceProcessor) -> frozenset[str]:
    """The vocabulary strings that, as a pre-token, encode as one token."""
    found = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        unit = model.id_to_piece(i).replace(SPACE, " ")
        if len(UNIT.findall(unit)) == 1 and count_unit(model, unit) == 1:
            found.add(unit)
    return frozenset(found)


class UnitCounts(dict):
    """Pre-token -> tokens: the proved ones, and the latest merged ones."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, proved: Iterable[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.model, self.proved, self.later = model, len(self), []

    def __missing__(self, unit: str) -> int:
        count = count_unit(self.model, unit)
        if len(unit) <= REMEMBERED_CHARS:
            if len(self.later) >= REMEMBERED_UNITS:
                for old in self.later:
                    del self[old]
                self.later.clear()
            self[unit] = count
            self.later.append(unit)
        return count

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, UNIT.findall(" " + text.replace(SPACE, " "))))


_LOADED: dict[str, Callable[[str], int]] = {}


def counter_of(key: str, model: bytes, proved: frozenset[str] | None) -> Callable[[str], int]:
    """The counting function of this worker, built on first use."""
    if key not in _LOADED:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        if proved is None:
            _LOADED[key] = lambda text: len(processor.encode(text))
        else:
            _LOADED[key] = UnitCounts(processor, proved).of_text
    return _LOADED[key]


def token_count(spark: SparkSession, model_path: str, text: str = "text") -> Column:
    """Number of tokens of a text column.

    The model is read on the driver, which proves the shortcut, and goes to
    the executors as a broadcast of the vocabulary's size.  A model for which
    the cuts can't be proved safe is applied to whole texts instead.
    """
    model = model_of(model_path)
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    proved = whole_tokens(processor) if cuts_are_safe(processor) else None
    shared = spark.sparkContext.broadcast((model, proved))
    key = hashlib.sha256(model).hexdigest()

    @arrow_function("long")
    def count(texts: pa.Array) -> pa.Array:
        of_text = counter_of(key, *shared.value)
        return pa.array([of_text(value.as_py()) for value in texts], pa.int64())

    return count(as_text(text))


def count_tokens(
    docs: DataFrame, model_path: str, *, text: str = "text", limit: int = 4096, prefix: str = ""
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit behind its columns.

    One row per row, repeated ones included; a null text is empty and has no
    token; an empty table stays empty.  No begin, end or added special token
    is counted.  A column of ``docs`` that has one of the new names keeps it,
    and the new one gets an underscore.
    """
    bytes_, tokens, over = fresh(docs.columns, prefix + "n_bytes", prefix + "n_tokens", prefix + "over_limit")
    counted = docs.withColumn(tokens, token_count(docs.sparkSession, model_path, text))
    return counted.select(
        *map(col, docs.columns),
        F.octet_length(as_text(text)).cast("long").alias(bytes_),
        col(tokens),
        (col(tokens) > limit).alias(over),
    )
