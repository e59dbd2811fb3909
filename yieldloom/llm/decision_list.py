"""Quality rules learned as an ordered list of threshold conjunctions.

Sequential covering: a conjunction is grown on one part of the labelled statistics,
condition by condition, until it covers no good document; it is pruned on the other
part; if it holds there, it joins the list and the documents it covers leave the
training rows. The list becomes a chain of Spark conditions on the same statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Labelled documents the list is learned from, at most.
SAMPLE = 20_000
MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, CANDIDATES = 0.9, 3, 4, 64

STATISTICS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_marks "
    "n_same_word"
).split()
STATISTICS_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in STATISTICS])

#: What rules may test: a statistic, or one divided by another.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "same_word_share": ("n_same_word", "n_words"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words found twice or more in the text, first included."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    total, covered_to = 0, 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            total += i + window - max(i, covered_to)
            covered_to = i + window
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers of ``STATISTICS`` for a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        digits,
        text.count("!") + text.count("?"),
        sum(a == b for a, b in zip(words, words[1:])),
    )


@F.pandas_udf(STATISTICS_TYPE)
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype="int64")


def base_failed(at: Column) -> Column:
    """Fixed rules that come before the learned ones; ``at`` is the statistics struct."""
    return (at["n_words"] < MIN_WORDS) | (
        100 * at["n_repeat_words"] > MAX_REPEAT_PERCENT * at["n_words"]
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, at: Column) -> Column:
        top, bottom = FEATURES[self.feature]
        value = at[top].cast("double")
        if bottom:
            value = F.when(at[bottom] > 0, value / at[bottom]).otherwise(0.0)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        value = table[self.feature].to_numpy()
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def features_of(stats: pd.DataFrame) -> pd.DataFrame:
    """Feature values as the Spark conditions compute them."""
    out = {}
    for name, (top, bottom) in FEATURES.items():
        value = stats[top].to_numpy(float)
        if bottom:
            base = stats[bottom].to_numpy(float)
            value = np.where(base > 0, value / np.where(base > 0, base, 1), 0.0)
        out[name] = value
    return pd.DataFrame(out)


def covers(rule: Rule, table: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(table), bool)
    for condition in rule:
        hit &= condition.holds(table)
    return hit


def _candidates(table: pd.DataFrame, bad: np.ndarray) -> Iterator[Condition]:
    """Borders halfway between neighbouring values at quantiles of the bad documents."""
    for name in table:
        values = np.unique(table[name].to_numpy())
        if len(values) < 2:
            continue
        marks = np.quantile(table[name].to_numpy()[bad], np.linspace(0, 1, CANDIDATES))
        at = np.unique(np.clip(np.searchsorted(values, marks), 1, len(values) - 1))
        for border in (values[at - 1] + values[at]) / 2:
            yield Condition(name, True, float(border))
            yield Condition(name, False, float(border))


def grow(table: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good document is covered."""
    rule: Rule = ()
    inside = np.ones(len(table), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        now, hits = table[inside], bad[inside]
        before = np.log2(hits.mean())
        best, gain = None, 1e-9
        for condition in _candidates(now, hits):
            hit = condition.holds(now)
            p, n = int((hit & hits).sum()), int((hit & ~hits).sum())
            if p and (value := p * (np.log2(p / (p + n)) - before)) > gain:
                best, gain = condition, value
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def prune(rule: Rule, table: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on."""

    def worth(r: Rule) -> float:
        hit = covers(r, table)
        return float((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

    beginnings = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(beginnings, key=lambda r: (round(worth(r), 9), -len(r)), default=rule)


def learn(stats: pd.DataFrame, bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """Ordered rules for rejecting; ``part`` marks the rows kept for pruning.

    A rule is accepted if enough of what it covers is bad, on the pruning rows and on
    all rows; the first that is not ends the list.
    """
    table, rules = features_of(stats).reset_index(drop=True), []
    left = np.ones(len(table), bool)
    while (left & ~part & bad).any():
        growing, pruning = left & ~part, left & part
        rule = grow(table[growing], bad[growing])
        if not rule:
            break
        if (pruning & bad).any():
            rule = prune(rule, table[pruning], bad[pruning])
        hit = covers(rule, table) & left
        for rows in (hit, hit & pruning):
            if rows.any() and (rows & bad).sum() < MIN_PRECISION * rows.sum():
                return rules
        if (hit & bad).sum() < MIN_COVER:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def chain(rules: list[Rule], at: Column) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    verdict = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        every = rule[0].column(at)
        for condition in rule[1:]:
            every = every & condition.column(at)
        verdict = F.when(every, number).otherwise(verdict)
    return verdict


def chosen_statistics(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int
) -> DataFrame:
    """(_id, _label, statistics, _failed, _part) of the documents that ``fit`` learns from."""
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # At most ``sample`` short rows.
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_label")
        .agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
        # Counted above the aggregate, where no filter on the counts reaches all texts.
        .select("_id", "_label", text_statistics("_text").alias("at"))
        .select("_id", "_label", "at.*", base_failed(F.col("at")).alias("_failed"))
        .withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3)) == 0)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> list[Rule]:
    """Learn the list from at most ``sample`` labelled documents (label 0: bad).

    The sample takes ids in the order of a hash. An id with several labels has the
    smallest; of several texts with one id, the one whose hash is smallest counts; null
    ids and labels are left out. Conditions of equal gain: the first in the order of
    features and borders. Only the chosen texts are counted, and only statistics reach
    the driver. Null and empty texts fail the fixed rules and teach nothing.
    """
    labelled = chosen_statistics(docs, labels, id_col, text_col, label_col, sample)
    rows = labelled.toPandas().sort_values("_id", kind="stable")
    rows = rows[~rows["_failed"].to_numpy(dtype=bool)]
    if not len(rows):
        return []
    return learn(
        rows[STATISTICS], rows["_label"].to_numpy() == 0, rows["_part"].to_numpy(dtype=bool)
    )


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_quality``: the statistics, base_failed, rule, kept.

    Null and empty texts have no words and fail the base. Every row is judged on its
    own, so repeated rows get the same verdict; an empty table gives no rows. Other
    columns are handed on untouched, whatever their names but ``_quality``.
    """
    at = F.col("_quality")
    rows = docs.withColumn("_quality", text_statistics(F.col(text_col)))
    failed, rule = base_failed(at), chain(rules, at)
    return rows.withColumn(
        "_quality",
        F.struct(
            *[at[name].alias(name) for name in STATISTICS],
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & rule.isNull()).alias("kept"),
        ),
    )
