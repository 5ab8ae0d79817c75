"""Quality rules: ordered lists of threshold conjunctions, learned by sequential covering.

The statistics of a text are columns; a learned list is a chain of Spark
conditions over them.  Learning sees a bounded sample of labelled rows only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perioda.llm.common import arrow_function, as_text, col, fresh

#: Labelled rows that learning may use; those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: A rule must reject at least this share of poor texts among those it meets, on rows it was not grown on.
MIN_PRECISION = 0.95
MIN_ROWS = 3
MAX_CONDITIONS = 4
MAX_RULES = 16
THRESHOLDS = 48
REPEAT_WINDOW = 5

_HASHES = 1 << 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OTHERS = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_twins")
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+="
_STATISTICS = pa.struct([(name, pa.int64()) for name in (*COUNTS, *_OTHERS)])

#: What conditions are made of: shares and means that do not grow with the text, and its length.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "words_per_line": "n_words / n_lines",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / n_words",
    "distinct_share": "n_distinct / n_words",
    "twin_share": "n_twins / n_words",
}


def repeated_words(numbers: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more; equal words have equal numbers."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    codes, size = numbers.astype(np.int64), int(numbers.max()) + 1
    base = size
    for k in range(1, window):
        codes = codes[:-1]
        if size * base >= 1 << 62:  # number the shorter windows anew, so that codes stay exact
            codes = np.unique(codes, return_inverse=True)[1]
            size = int(codes.max()) + 1
        codes, size = codes * base + numbers[k : k + len(codes)], size * base
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(numbers) + 1, np.int32)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics_of(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()  # on bytes: at space, tab and the line and page ends of ASCII
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        count(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(numbers),
        len(lines),
        count(_UPPER),
        count(_DIGITS),
        count(_MARKS),
        len(number),
        int(np.count_nonzero(numbers[1:] == numbers[:-1])),
    )


def text_statistics(text: str = "text") -> Column:
    """Struct of counts of a text column; a null text has no words."""

    @arrow_function(", ".join(f"{name} long" for name in (*COUNTS, *_OTHERS)))
    def measured(texts: pa.Array) -> pa.Array:
        columns = list(zip(*[statistics_of(value.as_py()) for value in texts])) or [[]] * len(_STATISTICS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_STATISTICS))

    return measured(as_text(text))


def base_failed(counts: Column) -> Column:
    """Fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        own = values[self.feature]
        return own > self.threshold if self.above else own <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        own = features[self.feature]
        return own > F.lit(self.threshold) if self.above else own <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(values) for c in self.conditions])

    def column(self, features: dict[str, Column]) -> Column:
        found = F.lit(True)
        for condition in self.conditions:
            found = found & condition.column(features)
        return found

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:g}" for c in self.conditions)


def _grow(values: dict[str, np.ndarray], poor: np.ndarray) -> list[Condition]:
    """Add the condition with the largest information gain until no good text is met."""
    rule: list[Condition] = []
    inside = np.ones(len(poor), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = poor[inside].sum(), (~poor[inside]).sum()
        if not p or not n:
            break
        best, best_gain = None, 1e-9
        before = np.log2(p / (p + n))
        for name in sorted(values):
            own = values[name][inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS + 1)[1:-1], method="lower"))
            at = np.searchsorted(cuts, own)  # number of cuts below the value
            p_at = np.bincount(at[poor[inside]], minlength=len(cuts) + 1)
            n_at = np.bincount(at[~poor[inside]], minlength=len(cuts) + 1)
            for above, ps, ns in (
                (False, np.cumsum(p_at)[:-1], np.cumsum(n_at)[:-1]),
                (True, p - np.cumsum(p_at)[:-1], n - np.cumsum(n_at)[:-1]),
            ):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0)
                if len(gain) and gain.max() > best_gain:
                    k = int(gain.argmax())
                    # Half way to the next value, so that a text close to the cut is on no edge.
                    beyond = own[own > cuts[k]]
                    edge = (cuts[k] + beyond.min()) / 2 if len(beyond) else cuts[k]
                    best, best_gain = Condition(name, above, float(edge)), gain.max()
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return rule


def _pruned(rule: list[Condition], values: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """The start of the rule that does best on rows it was not grown on."""

    def worth(length: int) -> tuple[float, int]:
        met = Rule(tuple(rule[:length])).holds(values)
        p, n = int(poor[met].sum()), int((~poor[met]).sum())
        return ((p - n) / (p + n) if p + n else -1.0, -length)

    return Rule(tuple(rule[: max(range(1, len(rule) + 1), key=worth)]))


def learn(values: dict[str, np.ndarray], poor: np.ndarray, *, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules for poor texts, in order.

    Each round grows a rule on two thirds of the rows that are left, prunes it
    on the rest, and keeps it if it is precise there; then what it meets goes.
    No labels, or labels of one kind, give no rule.
    """
    rules: list[Rule] = []
    left = np.ones(len(poor), bool)
    while len(rules) < MAX_RULES and poor[left].any() and not poor[left].all():
        at = np.flatnonzero(left)
        grown_on, held = at[np.arange(len(at)) % 3 > 0], at[np.arange(len(at)) % 3 == 0]
        part = lambda rows: {name: own[rows] for name, own in values.items()}  # noqa: E731, B023
        conditions = _grow(part(grown_on), poor[grown_on])
        if not conditions:
            break
        rule = _pruned(conditions, part(held), poor[held])
        met = rule.holds(part(held))
        if met.sum() < MIN_ROWS or poor[held][met].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~rule.holds(values)
    return rules


def features_of(counts: Column) -> dict[str, Column]:
    """FEATURES as columns over a struct of counts; an empty denominator gives 0."""
    found = {}
    for name, formula in FEATURES.items():
        above, _, below = formula.partition(" / ")
        found[name] = counts[above].cast("double")
        if below:
            found[name] = F.when(counts[below] > 0, found[name] / counts[below]).otherwise(0.0)
    return found


def verdict(rules: Sequence[Rule], counts: Column) -> Column:
    """False from the first rule that holds; true if none does."""
    features = features_of(counts)
    chain = None
    for rule in rules:
        held = rule.column(features)
        chain = F.when(held, False) if chain is None else chain.when(held, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Learn the rules from labelled documents; label 0 is poor.

    At most ``sample_rows`` labels are used, chosen by the hash of their id;
    they and their statistics are all that reaches the driver.  Rows without
    an id or a label don't count; an id with both labels is poor.
    """
    known = labels.filter(col(doc_id).isNotNull() & col(label).isNotNull())
    known = known.groupBy(col(doc_id).alias("__id")).agg(F.max(col(label) == 0).alias("__poor"))
    known = known.withColumn("__hash", F.pmod(F.xxhash64("__id"), F.lit(_HASHES)))
    # A cut that leaves a few more than the sample, so that tasks don't each send a full one to be sorted.
    cut = math.ceil(_HASHES * min(1.0, (1.2 * sample_rows + 1000) / max(1, known.count())))
    sample = known.filter(F.col("__hash") < cut).orderBy("__hash", "__id").limit(sample_rows)
    texts = docs.select(col(doc_id).alias("__id"), col(text).alias("__text"))
    # The sample has a fixed bound, so it may be sent to all.
    chosen = texts.join(F.broadcast(sample.drop("__hash")), "__id").select("__id", "__poor", text_statistics("__text").alias("s"))
    features = [own.alias(name) for name, own in features_of(F.col("s")).items()]
    # Not filtered by the statistics here: that would be pushed below the join and take those of all texts.
    rows = chosen.select("__id", "__poor", base_failed(F.col("s")).alias("__failed"), *features)
    rows = rows.orderBy(F.xxhash64("__id"), "__id", *FEATURES).limit(sample_rows).toPandas()
    rows = rows[~rows["__failed"]]
    values = {name: rows[name].to_numpy(float) for name in FEATURES}
    return learn(values, rows["__poor"].to_numpy(bool))


def judge(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the counts, base_failed and kept.

    Rows keep their number and columns.  A null or empty text has no words
    and so fails.
    """
    (state,) = fresh(docs.columns, "__counts")
    counted = docs.withColumn(state, text_statistics(text))
    counts = col(state)
    failed = base_failed(counts)
    kept = F.when(failed, False).otherwise(verdict(rules, counts))
    own = [counts[name].alias(name) for name in COUNTS]
    return counted.withColumn(out, F.struct(*own, failed.alias("base_failed"), kept.alias("kept"))).drop(state)


def keep_good(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    (state,) = fresh(docs.columns, "__quality")
    return judge(docs, rules, text=text, out=state).filter(col(state)["kept"]).drop(state)
