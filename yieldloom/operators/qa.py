"""Question sets: planning, duplicate questions, leakage-safe splits, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import text as X
from yieldloom.operators.ranking import position_in_group
from yieldloom.sources.scratch import checkpoint

# Number of casual speaking styles, and the split shares.
CASUAL_STYLES = 6
TRAIN_SHARE, VALID_SHARE = 0.8, 0.1


def qa_pending(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Sources that lack a formal or a casual question.

    The question type of an existing row stays fixed. Sources are numbered from
    1, so the speaking style follows from the number and needs no ordering.
    """
    state = rows.groupBy(F.col("source_id").alias("id")).agg(
        F.bool_or(F.col("phrasing") == "formal").alias("has_formal"),
        F.bool_or(F.col("phrasing") == "casual").alias("has_casual"),
        F.min_by("question_type", F.struct((F.col("phrasing") != "formal").alias("later"), "question_type")).alias("known_type"),
    )
    formal = F.coalesce("has_formal", F.lit(False))
    casual = F.coalesce("has_casual", F.lit(False))
    fixed = F.coalesce(
        "known_type", F.when(F.col("source_type") == "glossary_card", F.lit("term"))
    )
    return (
        sources.join(state, "id", "left")
        .filter(~(formal & casual))
        .select(
            F.col("id").alias("source_id"),
            "source_type",
            (~formal).alias("needs_formal"),
            (~casual).alias("needs_casual"),
            fixed.alias("question_type"),
            ((F.col("number") - 1) % CASUAL_STYLES).cast("int").alias("style"),
        )
    )


def normalize_question_types(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "question_type", X.question_type(F.col("question_type"), F.col("source_type"))
    )


def ambiguous_questions(rows: DataFrame) -> DataFrame:
    """Question texts that point to more than one source."""
    return (
        rows.groupBy("question")
        .agg(F.countDistinct("source_id").alias("n_sources"), F.min("source_id").alias("first_source"))
        .filter(F.col("n_sources") > 1)
    )


def leakage_safe_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Split name per source: whole sources, stratified by type, shared questions to train.

    The order inside a type is a salted hash of the id, so any partitioning
    gives the same split, and the first hash digits cut a large type into even
    buckets. Questions are compared by digest, so no text is moved.
    """
    asked = rows.select("source_id", "source_type", F.unhex(F.sha2("question", 256)).alias("question"))
    shared = (
        asked.groupBy("question")
        .agg((F.min("source_id") != F.max("source_id")).alias("shared"))
        .filter("shared")
    )
    # One row per source, written out because it is read three times below.
    sources = checkpoint(
        asked.join(shared, "question", "left")
        .groupBy("source_id")
        .agg(
            F.coalesce(F.min("source_type"), F.lit("")).alias("source_type"),
            F.coalesce(F.bool_or("shared"), F.lit(False)).alias("forced"),
        )
    )
    forced = sources.filter("forced").select("source_id", F.lit("train").alias("split"))
    free = (
        sources.filter(~F.col("forced"))
        .withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source_id", F.lit("")))))
        .withColumn("bucket", F.substr("hash", F.lit(1), F.lit(3)))
    )
    n = F.col("n")
    n_train = F.bround(n * TRAIN_SHARE).cast("long")
    n_valid = F.least(F.bround(n * VALID_SHARE).cast("long"), n - n_train)
    placed = position_in_group(
        free, ["source_type"], ["bucket"], ["hash", "source_id"], "place", total="n"
    )
    split = (
        F.when(F.col("place") <= n_train, "train")
        .when(F.col("place") <= n_train + n_valid, "valid")
        .otherwise("test")
    )
    return placed.select("source_id", split.alias("split")).unionByName(forced)


def apply_split(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with the split of their source; a null source is a source.

    A row whose source has no split ends the job that computes it, so none is lost in
    silence and no second pass counts them. ``leakage_safe_split`` has one row per source;
    for an assignment from elsewhere ``check_split_total`` finds sources in two splits.
    """
    named = assignment.withColumnRenamed("source_id", "_source_id")
    joined = rows.join(named, F.col("source_id").eqNullSafe(F.col("_source_id")), "left")
    missing = F.raise_error(F.concat(F.lit("no split for source "), F.coalesce("source_id", F.lit("null"))))
    return joined.withColumn("split", F.coalesce("split", missing)).drop("_source_id")


def check_split_total(rows: DataFrame, split_rows: DataFrame) -> None:
    """Every row must be in exactly one split."""
    before, after = rows.count(), split_rows.count()
    if before != after:
        raise ValueError(f"split changed the number of rows: {before} -> {after}")


def split_report(split_rows: DataFrame) -> DataFrame:
    """Rows and sources per split, and per split and source type, question type or phrasing."""
    columns = ["source_type", "question_type", "phrasing"]
    dimension, value = F.lit("all"), F.lit("")
    for column in columns:
        inside = F.grouping(column) == 0
        dimension = F.when(inside, F.lit(column)).otherwise(dimension)
        value = F.when(inside, F.col(column)).otherwise(value)
    sets = [[F.col("split")], *[[F.col("split"), F.col(c)] for c in columns]]
    per_source = split_rows.groupBy("split", "source_id", *columns).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return (
        per_source.groupingSets(sets, "split", *columns)
        .agg(
            F.sum("rows").alias("rows"),
            F.countDistinct("source_id").alias("sources"),
            dimension.alias("dimension"),
            value.alias("value"),
        )
        .select("split", "dimension", "value", "rows", "sources")
    )


def train_pairs(rows: DataFrame, texts: DataFrame, phrasing: str | None = None) -> DataFrame:
    """(question, indexed text of its source); the generated answer is not used."""
    chosen = rows if phrasing is None else rows.filter(F.col("phrasing") == phrasing)
    return chosen.join(texts.select(F.col("id").alias("source_id"), "text"), "source_id").select(
        F.col("question").alias("query"), F.col("text").alias("positive")
    )
