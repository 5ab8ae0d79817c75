"""Conversations from messages that quote each other.

Quoted lines are told from a message's own by their markers, nested levels
included.  Normalised passages are hashed; a quoted passage is joined to the
message of the same scope that has it first as its own text.  The links are
followed to the first message of each conversation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, as_text, col, fresh
from perioda.session import written

#: A line of fewer words says too little to find a message by.
MIN_LINE_WORDS = 4

_MARKERS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Says who is quoted; it belongs to the quotation if one follows.
_INTRODUCTION = re.compile(r".{1,200}\b(?:wrote|writes|said)\s*:\s*$")

_QUOTE = pa.struct([("level", pa.int32()), ("rank", pa.int32()), ("key", pa.binary())])
_PARSED = pa.struct([("own", pa.string()), ("keys", pa.list_(pa.binary())), ("quotes", pa.list_(_QUOTE))])


def level_of(line: str) -> tuple[int, str]:
    """Number of markers in front of a line, and the line behind them."""
    found = _MARKERS.match(line)
    return (found[1].count(">"), line[found.end() :]) if found else (0, line)


def blocks(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level; an introduction goes with the quotation behind it."""
    found: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, rest = level_of(line)
        if not found or found[-1][0] != level:
            found.append((level, []))
        found[-1][1].append(rest)
    for (level, lines), (after, _) in zip(found, found[1:]):
        while lines and not lines[-1].strip():
            lines.pop()
        if after > level and lines and _INTRODUCTION.match(lines[-1]):
            lines.pop()
    return [(level, lines) for level, lines in found if any(line.strip() for line in lines)]


def key_of(passage: str) -> bytes:
    """128-bit hash of a passage without regard to case and white space."""
    return xxhash.xxh3_128_digest(" ".join(passage.lower().split()).encode())


def keys_of(lines: Sequence[str]) -> list[bytes]:
    """The whole passage first, then its lines, longest first."""
    single = sorted((line for line in lines if len(line.split()) >= MIN_LINE_WORDS), key=lambda x: (-len(x), x))
    return list(dict.fromkeys([key_of(" ".join(lines)), *map(key_of, single)]))


def parse(text: str) -> dict:
    """Own text, keys of the own passages, and keys of the quoted ones with level and rank."""
    found = blocks(text)
    own = [lines for level, lines in found if level == 0]
    if len(found) > 1:
        own = ["\n".join(lines).strip("\n").split("\n") for lines in own]
    every = [line for lines in own for line in lines]
    keys = [key for lines in own for key in keys_of(lines)] + (keys_of(every) if every else [])
    quotes = [
        {"level": level, "rank": min(rank, 1), "key": key}
        for level, lines in found
        if level
        for rank, key in enumerate(keys_of(lines))
    ]
    return {"own": "\n".join("\n".join(lines) for lines in own).strip("\n"), "keys": list(dict.fromkeys(keys)), "quotes": quotes}


def _parsed(text: str) -> Column:
    @arrow_function("own string, keys array<binary>, quotes array<struct<level: int, rank: int, key: binary>>")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([parse(value.as_py()) for value in texts], _PARSED)

    return parsed(as_text(text))


def _roots(parents: DataFrame) -> DataFrame:
    """(node, o, root, top, depth) from (node, parent, o), ``o`` being the parent's order and ``top`` the root's.

    Only messages that are answered have somebody below them; their steps
    upwards are doubled, and all others take their parent's root at the end.
    A row that has reached its root leaves, and of the rest only what somebody
    still points to is looked up, so a round is no larger than what lies that
    deep.  Parents come before their children, so there is no circle, and a
    conversation n replies deep takes log2(n) rounds, each a written table.
    """
    answered = parents.select(F.col("parent").alias("node")).distinct()
    inner = parents.join(answered, "node", "left_semi")
    rows = inner.select(
        "node", F.col("parent").alias("root"), F.col("o").alias("top"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")
    )
    active = above = written(rows, "replies")
    settled = active.limit(0).drop("done")
    while not active.isEmpty():
        steps = above.select(
            F.col("node").alias("root"), F.col("root").alias("up"), F.col("top").alias("up_top"), F.col("depth").alias("more"), F.col("done").alias("last")
        )
        known = F.col("up").isNotNull()
        joined = active.drop("done").join(steps, "root", "left").select(
            "node",
            F.coalesce("up", "root").alias("root"),
            F.when(known, F.col("up_top")).otherwise(F.col("top")).alias("top"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("last", F.lit(True)).alias("done"),
        )
        joined = written(joined, "replies")
        settled = settled.unionByName(joined.filter("done").drop("done"))
        active = joined.filter("not done")
        pointed = active.select(F.col("root").alias("node")).distinct()
        above = above.filter("done").unionByName(joined).join(pointed, "node", "left_semi")
        above = written(above, "replies-above")
    own = settled.select(F.col("node").alias("parent"), "root", "top", "depth")
    return parents.join(own, "parent", "left").select(
        "node",
        "o",
        F.coalesce("root", "parent").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("top")).otherwise(F.col("o")).alias("top"),
        (F.coalesce("depth", F.lit(0).cast("long")) + 1).alias("depth"),
    )


def link(messages: DataFrame, *, scope: Sequence[str] = (), order: str, text: str = "text") -> DataFrame:
    """``messages`` with quotes cut from ``text``, and parent, root and depth.

    ``order`` says which message came first; messages of different ``scope``
    (a list, a mailbox, a conversation) are never linked.  The parent is the
    message that a quoted passage comes from: of the outermost level of which
    any passage is found; whole passages before single lines; then the latest
    message.  A passage comes from the first message of the scope that has it
    as its own text, and only an earlier one can be a parent.  ``parent`` and
    ``root`` are values of ``order``; a message without a parent has a null
    parent, itself as root, and depth 0.  Sorted by scope, root, depth and
    order, every reply follows what it answers.

    Rows and other columns stay.  Rows with equal scope, order and text are
    one message and fare alike; of equal order and different texts, each is a
    message.  A null text has nothing quoted; a null order comes first, a null
    scope is a scope.  A column that has one of the new names keeps it, and
    the new one gets an underscore.
    """
    parent, root, depth = fresh(messages.columns, "parent", "root", "depth")
    node, own, up, top, deep = fresh([*messages.columns, parent, root, depth], "__node", "__own", "__up", "__top", "__deep")
    keys = [*scope, order]
    identity = [*[col(k).isNull() for k in keys], *[col(k) for k in keys], as_text(text)]
    # Two hashes that differ in their start make 128 bits.
    hashed = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *identity)), 16, "0") for k in (0, 1)])
    marked = messages.withColumn(node, hashed)
    scope_hash = F.xxhash64(F.lit(0), *[col(s).isNull() for s in scope], *[col(s) for s in scope])
    rows = marked.select(
        col(node).alias("node"), scope_hash.alias("scope"), F.struct(col(order).alias("o"), col(node).alias("n")).alias("at"),
        _parsed(text).alias("p"),
    )
    rows = written(rows.select("node", "scope", "at", "p.own", "p.keys", "p.quotes"), "messages")

    index = rows.select("scope", "at", F.explode("keys").alias("key"))
    # Written, so that the join is not bound to the grouping's partitions and a frequent passage can be split.
    index = written(index.groupBy("scope", "key").agg(F.min("at").alias("origin")), "passages")
    asked = rows.select("node", "scope", "at", F.explode("quotes").alias("q"))
    asked = asked.select("node", "scope", "at", "q.level", "q.rank", "q.key")
    found = asked.join(index, ["scope", "key"]).filter(F.struct("origin.o") < F.struct("at.o"))
    best = found.groupBy("node").agg(
        F.max_by("origin", F.struct(-F.col("level"), -F.col("rank"), "origin")).alias("origin"),
    )
    parents = written(best.select("node", F.col("origin.n").alias("parent"), F.col("origin.o").alias("o")), "parents")
    named = _roots(parents).select(
        F.col("node").alias(node), F.col("o").alias(up), F.col("top").alias(top), F.col("depth").alias(deep)
    )

    texts = rows.select(F.col("node").alias(node), F.col("own").alias(own)).dropDuplicates([node])
    joined = marked.join(texts, node).join(named, node, "left")
    return joined.select(
        *[F.when(col(c).isNotNull(), col(own)).alias(c) if c == text else col(c) for c in messages.columns],
        col(up).alias(parent),
        F.when(col(deep).isNull(), col(order)).otherwise(col(top)).alias(root),
        F.coalesce(col(deep), F.lit(0).cast("long")).alias(depth),
    )


def with_quotes(turns: DataFrame, *, scope: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``turns`` as mail programs send them: behind each text the two before it, quoted once and twice.

    Of several texts at one place of a conversation, the smallest is the one that later mails quote.
    """
    s, o, t, mail, *quoted = fresh(turns.columns, "__s", "__o", "__t", "__mail", "__t1", "__t2")
    before = turns.groupBy(col(scope).alias(s), col(order).alias(o)).agg(F.min(col(text)).alias(t))
    # Each text goes to the two places behind it, so one join brings both.
    levels = F.explode(F.array(F.lit(1), F.lit(2)))
    back = before.withColumn(mail, levels).groupBy(col(s), (col(o) + col(mail)).alias(o))
    back = back.agg(*[F.max(F.when(col(mail) == k, col(t))).alias(q) for k, q in enumerate(quoted, 1)])
    mailed = turns.join(back, (col(scope) == col(s)) & (col(order) == col(o)), "left")
    parts = [as_text(text), *[F.regexp_replace(col(q), "(?dm)^", ">" * k + " ") for k, q in enumerate(quoted, 1)]]
    mailed = mailed.withColumn(mail, F.concat_ws("\n", *parts))
    return mailed.select(*[col(mail).alias(c) if c == text else col(c) for c in turns.columns])
