"""Sampling documents to source targets with the cube method.

Every document of a source starts with the same inclusion probability. The flight
phase moves these along vectors that leave two totals of the source unchanged, the
number of words and the number of documents, until the probabilities are 0 or 1 for all
but a few documents. Groups of a source fly on their own; what each leaves undecided,
a dozen documents at most, flies together in the next round. The landing problem of the
last round is so small that all its outcomes are looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import WORD, written
from yieldloom.operators.joins import joined_side

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a group that flies in one task.
GROUP = 2_000
#: Documents of a group that stay undecided for the next round or the landing.
LANDING = 10
EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, source_size, n_docs).

    Sources by code point, null last, take the weights in turn. A target is the
    smaller of ``most`` times the source and a level times its weight; the level is
    where all targets add up to ``share`` of everything, which is what resharing the
    excess by weight comes to. Found in closed form: sources fill up in the order of
    their size per weight, so sums over that order give the level.
    """
    # One row per source, and a handful of numbers in each.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.array(*map(F.lit, weights))[turn])
    weighted = weighted.withColumn("full", F.col("source_size") * most)
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    from_here = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    open_words = share * F.sum("source_size").over(every) - F.coalesce(
        F.sum("full").over(before), F.lit(0.0)
    )
    # The level if this source is the first that is not full.
    levels = weighted.withColumn("level", open_words / from_here)
    fits = F.col("level") * F.col("weight") <= F.col("full")
    level = F.min(F.when(fits, F.struct(F.col("full") / F.col("weight"), "level"))).over(every)
    return levels.withColumn("level", level["level"]).select(
        "source",
        "source_size",
        "n_docs",
        "weight",
        F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"),
    )


def fly(sizes: np.ndarray, chances: np.ndarray, draw: Callable[[], float]) -> np.ndarray:
    """Flight phase: chances become 0 or 1 but for two at most, in expectation unchanged.

    Three undecided documents at a time move along the vector that changes neither
    their words nor their number; with equal sizes, two of them trade places.
    """
    chances = chances.copy()
    pool: list[int] = []
    size, chance = sizes.tolist(), chances.tolist()
    for i in range(len(size)):
        if not EDGE < chance[i] < 1 - EDGE:
            continue
        pool.append(i)
        while len(pool) >= 3:
            a, b, c = pool
            move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if move == (0, 0, 0):
                move = (1, -1, 0)
            _step(chance, pool, move, draw)
            pool = [k for k in pool if EDGE < chance[k] < 1 - EDGE]
    return np.array(chance)


def _step(chance: list[float], pool: list[int], move: tuple, draw: Callable[[], float]) -> None:
    """Go as far as possible along ``move`` or against it, so that the mean stays."""
    up = down = math.inf
    for k, m in zip(pool, move):
        if m > 0:
            up, down = min(up, (1 - chance[k]) / m), min(down, chance[k] / m)
        elif m < 0:
            up, down = min(up, chance[k] / -m), min(down, (1 - chance[k]) / -m)
    step = up if draw() * (up + down) < down else -down
    for k, m in zip(pool, move):
        value = chance[k] + step * m
        chance[k] = 0.0 if value < EDGE else 1.0 if value > 1 - EDGE else value


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Decide the last few: the outcome whose words, then documents, are nearest to the target."""
    open_ones = np.flatnonzero((chances > EDGE) & (chances < 1 - EDGE))
    if not len(open_ones):
        return np.round(chances)
    k = len(open_ones)
    picks = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    size, chance = sizes[open_ones].astype(float), chances[open_ones]
    words = np.abs(picks @ size - size @ chance)
    docs = np.abs(picks.sum(axis=1) - chance.sum())
    best = np.lexsort((np.arange(1 << k), docs, np.round(words, 6)))[0]
    out = np.round(chances)
    out[open_ones] = picks[best]
    return out


def _round(last: bool, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Decide one group. Only sizes, chances and the order are looked at; the rest is handed on."""

    def decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("order", "ascending")])
        sizes, chances = table["size"].to_numpy(), table["chance"].to_numpy().copy()
        source, cell = (k.as_py() for k in key)
        rng = np.random.default_rng([seed, zlib.crc32(f"{source}|{int(cell)}".encode())])
        draws = iter(rng.random(2 * len(sizes) + 8).tolist())
        # Sizes from the largest to the smallest stay open, so that the landing's outcomes
        # lie close together.
        open_ones = np.linspace(0, len(sizes) - 1, min(LANDING, len(sizes))).round().astype(int)
        flying = np.ones(len(sizes), bool)
        flying[open_ones] = False
        chances[flying] = fly(sizes[flying], chances[flying], lambda: next(draws))
        if last:
            chances = land(sizes, chances)
        at = table.column_names.index("chance")
        return table.set_column(at, "chance", pa.array(chances)).drop_columns(["cell"])

    return decide


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    group: int = GROUP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target, repeats, and the columns in ``carry``.

    ``repeats`` (0 up to ``most``, rounded up) is how often the document goes into the mix: its
    chance's whole part, and one more if the sample takes it. Documents without words
    take no part (repeats 0). Groups and draws depend on ids, texts and sources alone, so a
    rerun on any cluster agrees; rows equal in all three may trade places. Rows with the
    same id are documents of their own; a null source is a source; a null text has no
    words; texts are read whole; an empty table gives no rows.

    Chances are kept in expectation by the flight. The landing is not random: it takes
    the outcome nearest to the totals, and for that ``LANDING`` documents of every group,
    spread over its sizes, stay out of the flight and go to the next round.

    The text is read once, for its word counts; only (id, source, size) moves.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), id_col, text_col).alias("order"),
            F.struct(F.lit(True).alias("_"), *carry).alias("carried"),
        ),
        "sizes",
    )
    by_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("n_docs"),
    )
    plan = written(targets(by_source, weights, share, most), "targets")
    n_sources, largest = plan.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    side = joined_side(plan.withColumnRenamed("source", "_source"), n_sources)
    placed = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumn("chance", F.when(F.col("size") > 0, chance).otherwise(0.0))
    # Whole repeats first; what is left over is a chance below one.
    whole = F.floor(F.col("chance") + EDGE)
    open_rows = placed.withColumn("repeats", whole).withColumn(
        "chance", F.greatest(F.col("chance") - whole, F.lit(0.0))
    )
    schema = open_rows.schema
    done = open_rows.filter(F.col("chance") <= EDGE)
    flying = open_rows.filter(F.col("chance") > EDGE)
    level, rows_left = 0, int(largest or 0)
    while True:
        groups = max(1, math.ceil(rows_left / group))
        cell = F.pmod(F.xxhash64(F.lit(level), "order"), F.lit(groups))
        last = groups == 1
        decided = written(
            flying.withColumn("cell", cell)
            .groupBy("source", "cell")
            .applyInArrow(_round(last, seed + level), schema),
            f"flight-{level}",
        )
        if last:
            done = done.unionByName(decided)
            break
        settled = (F.col("chance") <= EDGE) | (F.col("chance") >= 1 - EDGE)
        done = done.unionByName(decided.filter(settled))
        flying = decided.filter(~settled)
        rows_left = groups * (LANDING + 2)
        level += 1
    return done.select(
        F.col("id").alias(id_col),
        F.col("size"),
        "source_size",
        "target",
        (F.col("repeats") + F.round("chance")).cast("long").alias("repeats"),
        *[F.col("carried").getField(c).alias(c) for c in carry],
    )
