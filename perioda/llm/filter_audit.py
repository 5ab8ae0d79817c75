"""Audit of what filters remove in every order they can be applied in.

A row that fails some filters is removed, in a given order, at the first of
them: the minimum over the failed filters of their position.  So the mask
matrix (0 where a filter is failed, beyond all positions else) is combined
with the matrix of positions, which are the orders' inverse permutations, by
addition and minimum.  Rows with equal masks are counted first, and the
counts, weighted in several ways, are scattered to (order, removal step).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, as_text, col, fresh, ship_package, utf8

#: The text filters A to D: fewest words, least share of distinct words, most capitals (hundredths), symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
FILTERS = "ABCDE"
#: More filters have too many orders for one answer.
MOST_FILTERS = 7

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INNER_BYTES = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bit 0 to 3: whether the text fails A to D."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _INNER_BYTES)))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT * len(words),
        100 * capitals > MAX_CAPITALS * points,
        len(text) != len(text.translate(None, SYMBOLS)),
    )
    return sum(failed << k for k, failed in enumerate(fails))


def text_masks(text: str = "text") -> Column:
    @arrow_function("int")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([text_mask(v.as_py()) for v in texts], pa.int32())

    return masked(utf8(text))


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(masks x orders): the step, from 0, that removes a mask's rows; the number of filters if none does.

    Min-plus product of the masks (masks x filters, true where failed) with
    the filters' positions in each order (orders x filters).
    """
    filters = positions.shape[1]
    away = np.where(masks, 0, filters)
    return np.minimum((away[:, None, :] + positions[None]).min(axis=2), filters)


def orders_of(names: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """All orders, by their letters' order in ``names``, and each one's position of every filter."""
    orders = list(itertools.permutations(range(len(names))))
    return ["".join(names[k] for k in order) for order in orders], np.argsort(np.array(orders), axis=1)


def scattered(masks: np.ndarray, weights: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(orders x steps x weights): what each step removes."""
    orders, filters = positions.shape
    steps = removal_steps(masks, positions)
    found = np.zeros((orders, filters + 1, weights.shape[1]), np.int64)
    place = np.broadcast_to(np.arange(orders), steps.shape)
    np.add.at(found, (place, steps), np.broadcast_to(weights[:, None, :], (*steps.shape, weights.shape[1])))
    return found[:, :filters]


def order_table(counted: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Rows (part, mask, rows, good, toxic), one a part and mask -> one row for each part, order and step.

    A part has as many rows here as there are masks at most.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"an audit has 1 to {MOST_FILTERS} filters")
    ship_package(counted.sparkSession)

    def table(key: tuple, held: pa.Table) -> pa.Table:
        orders, positions = orders_of(names)
        failed = (held.column("mask").to_numpy()[:, None] >> np.arange(len(names)) & 1).astype(bool)
        weights = np.stack([held.column(c).to_numpy() for c in ("rows", "good", "toxic")], axis=1).astype(np.int64)
        removed = scattered(failed, weights, positions)
        rows = weights[:, 0]
        fails = failed.T.astype(np.int64) @ rows
        alone = (failed & (failed.sum(axis=1) == 1)[:, None]).T.astype(np.int64) @ rows
        at = np.argsort(positions, axis=1)  # the filter of each step
        shapley = np.zeros(len(names), np.int64)
        np.add.at(shapley, at, removed[:, :, 0])
        columns = {
            "filter_order": np.repeat(np.array(orders, object), len(names)),
            "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders)),
            "kept": (rows.sum() - np.cumsum(removed[:, :, 0], axis=1)).ravel(),
            "removed": removed[:, :, 0].ravel(),
            "redundant": (fails[at] - removed[:, :, 0]).ravel(),
            "unique_fails": alone[at].ravel(),
            "good_lost": removed[:, :, 1].ravel(),
            "toxic_lost": removed[:, :, 2].ravel(),
            "shapley": shapley[at].ravel(),
        }
        part = pa.array([key[0].as_py()] * len(columns["step"]), pa.string())
        return pa.table({"part": part, **{name: pa.array(values) for name, values in columns.items()}})

    longs = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counted.groupBy("part").applyInArrow(table, f"part string, filter_order string, step int, {longs}")


def audit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """What each of the five filters removes, in each of their 120 orders, within each part.

    A: under 100 words; B: too few distinct words; C: too many capitals; D: a
    symbol; E: a text that a row with a smaller id has too, in the whole table
    and whatever is removed.  A null text is empty, and so is a null part.  A
    null id comes behind all others; rows with equal ids are not smaller than
    each other.  ``labels`` (doc_id, quality, toxic) may have several rows or
    none for an id: a document is good if one says 1, and toxic likewise; a
    null id has no labels.  An empty table has no parts.

    Texts are told apart by their SHA-256.  Only digests, ids and masks are
    shuffled.  Copies of a text meet in a minimum that is taken before the
    shuffle too, and are found again by (digest, id), which no group of
    copies makes hot.
    """
    (of,) = fresh(labels.columns, "__of")
    rows = docs.select(
        col(doc_id).alias("id"), as_text(part).alias("part"), F.unhex(F.sha2(utf8(text), 256)).alias("digest"), text_masks(text).alias("mask")
    )
    first = rows.groupBy(F.col("digest").alias("first_digest")).agg(F.min("id").alias("first_id"))
    same = (F.col("digest") == F.col("first_digest")) & F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.join(first, same, "left")
    copy = F.when(F.col("first_digest").isNull(), 1 << 4).otherwise(0)
    rows = rows.select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
    said = labels.groupBy(col(doc_id).alias(of)).agg(
        F.max((col("quality") == 1).cast("int")).alias("good"), F.max((col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(said, F.col("id") == F.col(of), "left")
    counted = rows.groupBy("part", "mask").agg(
        F.count("*").alias("rows"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    return order_table(counted)
