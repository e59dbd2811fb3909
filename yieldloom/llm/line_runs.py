"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch leaves one run: line hashes with the number of
documents that hold them and the largest id among these, sorted by hash. Before it
does, it is merge-anti-joined with the runs already there: lines that are settled
(enough documents, and kept in a document with an id at least as large) need no
further bookkeeping. After every ``fanout`` runs of one level these are merged into
one run of the next, so that few runs are ever read and each hash is rewritten only
once per level.

All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm.common import BLANKS, ascii_lower, written

MIN_CHARS, MIN_DOCS = 40, 5
KEY = ["h1", "h2"]
BATCHES, FANOUT = 4, 2


def lines_of(text: Column) -> Column:
    """Lines of a text, split at ``\\n``; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def hashes_of(key: Column) -> list[Column]:
    """128 bits, so that two different lines don't meet even among 10^12."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, h1, h2) for each different long line of each document; ``docs`` has id and text."""
    keys = F.array_distinct(
        F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.length(k) >= min_chars)
    )
    return docs.select("id", F.explode(keys).alias("key")).select("id", *hashes_of(F.col("key")))


def merged(rows: DataFrame) -> DataFrame:
    """One row per hash; counts add up and the largest keeper wins, in any order of merging."""
    return rows.groupBy(*KEY).agg(
        F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id")
    )


def sorted_run(rows: DataFrame) -> DataFrame:
    """Write a run: range-partitioned and sorted by hash."""
    return written(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY), "run")


@dataclass
class LineRuns:
    """The runs so far, by level. ``add`` takes a batch of (h1, h2, n_docs, keep_id)."""

    spark: SparkSession
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch that the runs have not settled (merge-anti-join).

        A settled hash has enough documents in one run, and its keeper's id is at
        least that of the batch; counting further documents can't change its fate.
        """
        for run in self.runs():
            settled = run.filter(F.col("n_docs") >= self.min_docs).select(
                *KEY, F.col("keep_id").alias("_keep")
            )
            later = F.col("_keep") >= F.coalesce(F.col("keep_id"), F.col("_keep"))
            batch = (
                batch.alias("b")
                .join(
                    settled.hint("merge").alias("s"),
                    (F.col("b.h1") == F.col("s.h1")) & (F.col("b.h2") == F.col("s.h2")) & later,
                    "left_anti",
                )
                .select("b.*")
            )
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Anti-join the batch with the runs, add what is left as a run, compact; returns the run."""
        run = sorted_run(self.fresh(batch))
        self._put(run, 0)
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(sorted_run(merged(reduce(DataFrame.unionByName, full))), level + 1)

    def repeated(self) -> DataFrame | None:
        """(h1, h2, keep_id) of the hashes found in at least ``min_docs`` documents."""
        runs = self.runs()
        if not runs:
            return None
        # A single run is already merged.
        state = runs[0] if len(runs) == 1 else merged(reduce(DataFrame.unionByName, runs))
        return state.filter(F.col("n_docs") >= self.min_docs).select(*KEY, "keep_id")


def batches_of(docs: DataFrame, n: int) -> Column:
    """Batch number by id, largest ids first, so that most keepers are settled early.

    The borders are approximate quantiles; any borders give the same result.
    """
    shares = [i / n for i in range(n - 1, 0, -1)]
    borders = docs.agg(F.percentile_approx("id", shares, 1000)).first()[0] or []
    number: Column = F.lit(len(borders))
    for i, border in reversed(list(enumerate(borders))):
        number = F.when(F.col("id") > border, i).otherwise(number)
    return number.cast("int")


def dedupe_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    n_batches: int = BATCHES,
    fanout: int = FANOUT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, and ``text`` as it is after dropping.

    ``carry`` names further columns to hand on, as fields of a struct ``carried``.

    A line goes if its key has ``min_chars`` code points or more, is found in
    ``min_docs`` documents or more, and its document is not the one with the largest
    id among them. Null and empty texts are one empty line and come back as an empty
    text. Rows are documents: repeated rows with one id count one by one, and as
    equals in the largest id they all keep the line. A null id is smaller than any
    other. An empty table gives no rows. No other columns are read.

    The text is shuffled once, by id, to meet the positions of its dropped lines;
    before that only hashes move.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(F.lit(True).alias("_"), *carry).alias("carried"),
    )
    staged = written(
        occurrences(source, min_chars)
        .withColumn("batch", batches_of(source, n_batches))
        .groupBy("batch", *KEY)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id")),
        "lines",
        ["batch"],
    )
    runs = LineRuns(spark, min_docs, fanout)
    for number in sorted(r[0] for r in staged.select("batch").distinct().collect()):
        runs.add(staged.filter(F.col("batch") == number).drop("batch"))
    repeated = runs.repeated()
    if repeated is None:
        return _outcome(source.withColumn("drop", F.lit(None).cast("array<int>")), id_col)
    repeated = written(repeated, "repeated")
    keys = F.transform(lines_of(F.col("text")), key_of)
    long_lines = F.filter(
        F.transform(keys, lambda k, i: F.struct(i.alias("pos"), k.alias("key"))),
        lambda x: F.length(x["key"]) >= min_chars,
    )
    # The text's hash beside the id keeps apart rows that share an id.
    placed = source.select(
        "id", F.xxhash64("text").alias("th"), F.explode(long_lines).alias("line")
    ).select("id", "th", F.col("line.pos").alias("pos"), *hashes_of(F.col("line.key")))
    gone = (
        placed.join(repeated, KEY)
        .filter(~F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("drop"))
    )
    gone = written(gone, "dropped").select(F.col("id").alias("_id"), F.col("th").alias("_th"), "drop")
    # A table that grows with the documents is merged at every size, never broadcast.
    whole = source.withColumn("th", F.xxhash64("text")).join(
        gone.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left"
    )
    return _outcome(whole, id_col)


def _outcome(rows: DataFrame, id_col: str) -> DataFrame:
    """Lines without those at the positions in ``drop``."""
    none = F.array().cast("array<int>")
    drop = F.coalesce(F.col("drop"), none)
    lines = lines_of(F.col("text"))
    # Positions that stay, by set difference: linear in the lines of a document.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.when(F.size(drop) == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    return rows.select(
        F.col("id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_dropped"),
        kept.alias("text"),
        "carried",
    )
