"""Exact duplicates by digest, with heavy hitters split off.

A group of copies may hold a large share of all rows, and an ordinary shuffle by
digest would bring it to one task. A Misra-Gries summary finds the frequent
digests; an exact count verifies them; the few that are confirmed are broadcast
and their rows answered where they are. All other rows go through an ordinary
shuffle, in which no group can be larger than the summary's error bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import ascii_lower, written

#: Counters of a summary. A digest with more than 3.5 / COUNTERS of all rows is always
#: among them (the error bound of the sketch, a Misra-Gries variant).
COUNTERS = 2048
#: Most digests that are broadcast: 80 bytes each.
WINNERS = 1024
#: Summaries are merged in so many groups first, so that the last task sees few of them.
MERGE_GROUPS = 64


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and SHA-256 (lowercase hex) of each text after lower-casing A-Z; null counts as empty."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("digest")
    )


def frequent(rows: DataFrame, counters: int = COUNTERS, winners: int = WINNERS) -> DataFrame:
    """Candidates for heavy digests: one row per digest, ``winners`` at most.

    Each task keeps a bounded summary; summaries are merged in two steps.
    """
    partial = rows.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("s")
    )
    # Grouped by a constant: an empty table has no summary, which can't be combined.
    merged = partial.groupBy(F.lit(0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(s, {counters})").alias("s")
    )
    top = F.explode(F.expr(f"approx_top_k_estimate(s, {winners})")).alias("top")
    return merged.select(top).select(F.col("top.item").alias("digest"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    winners: int = WINNERS,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; of equal
    texts the row with the largest id stays. A null text counts as empty, a null
    id is smaller than any other. Rows repeated with the same largest id are all
    kept: they can't be told apart. An empty table gives no rows; other columns
    are not read.

    Only digests move: the text is read once and never shuffled.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    best = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # Verified winners: exact size and keeper, pre-aggregated in every task.
    candidates = written(frequent(rows, counters, winners), "candidates")
    heavy = written(
        rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*best),
        "heavy",
    )
    # At most ``winners`` rows, so the broadcast is bounded whatever the input.
    answered = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    sizes = written(rest.groupBy("digest").agg(*best), "light")
    joined = rest.join(sizes.hint("merge"), "digest")
    return answered.unionByName(joined).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
