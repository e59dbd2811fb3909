"""Corpus and evaluation files: readers, parsers of their text, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.functions import text as X

FILE_STEM = r"([^/]+?)(\.[^./]*)?$"


def read_strip_files(spark: SparkSession, path: str) -> DataFrame:
    """Map files, one row each; the file name is the strip id."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", FILE_STEM, 1).alias("strip_id"),
        F.col("value").alias("content"),
    )


def read_corpus_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Card or chunk lines with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def parse_corpus_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The same for a table of JSON lines."""
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def front_matter(content: Column) -> Column:
    """Leading '---' block as map; empty values are null, a repeated key keeps its last value."""
    block = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda line: line.contains(":"))
    entries = F.transform(
        lines,
        lambda line: F.struct(
            X.strip(F.substring_index(line, ":", 1)).alias("key"),
            F.nullif(X.strip(F.substr(line, F.instr(line, ":") + 1)), F.lit("")).alias("value"),
        ),
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(
            F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]
        ),
    )
    return F.map_from_entries(last)


def split_front_matter(files: DataFrame) -> DataFrame:
    """(doc_id, content) -> (doc_id, meta map, body)."""
    whole = F.regexp_extract("content", r"(?s)\A---\n.*?\n---\n", 0)
    return files.select(
        "doc_id",
        front_matter(F.col("content")).alias("meta"),
        F.substr("content", F.length(whole) + 1).alias("body"),
    )


def read_clean_docs(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter; id is folder and file stem."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.regexp_replace(
            F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+?)(\.[^./]*)?$", 1), "/", "-"
        ).alias("doc_id"),
        F.col("value").alias("content"),
    )
    return split_front_matter(files)


CASE_SCHEMA = (
    "id string, query string, lot_id string, expected_intent string, event_id string, "
    "event_type string, related_doc string, expected_tools array<string>, "
    "expected_keywords variant"
)


def keyword_groups(keywords: Column) -> Column:
    """['a', ['b', 'c']] -> [['a'], ['b', 'c']]: each group is any-of."""
    items = keywords.cast("array<variant>")
    return F.transform(
        items,
        lambda item: F.when(
            F.startswith(F.schema_of_variant(item), F.lit("ARRAY")),
            F.try_variant_get(item, "$", "array<string>"),
        ).otherwise(F.array(F.try_variant_get(item, "$", "string"))),
    )


def parse_eval_cases(files: DataFrame) -> DataFrame:
    """Case files {"cases": [...]} in a text column -> one row per case."""
    cases = files.select(
        F.explode(
            F.from_json("content", f"cases array<struct<{_struct_fields(CASE_SCHEMA)}>>")["cases"]
        ).alias("c")
    ).select("c.*")
    return cases.withColumn("expected_keywords", keyword_groups(F.col("expected_keywords")))


def _struct_fields(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in ddl.split(", "))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_eval_cases(
        spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))
    )


#: What a turn of a case file may expect, by the name the checks use for it. Fixed names of the format.
TURN_FIELDS = {
    "query": ("query", "string"),
    "expect_label": ("expect_intent", "string"),
    "expect_lot_id": ("expect_lot_id", "string"),
    "expect_tool": ("expect_tool", "string"),
    "expect_input": ("expect_tool_input", "map<string,string>"),
    "expect_words": ("expect_answer_contains", "array<string>"),
}


def parse_turn_cases(files: DataFrame) -> DataFrame:
    """Case files {"conversations": [{"id", "turns": [...]}]} in a text column -> one row per turn.

    ``turn`` counts from 1 in the order of the file. What a turn does not state is null and
    is not checked. A file that is no JSON, or holds no conversations, gives no rows; so does
    a conversation without turns.
    """
    table = files.sparkSession.tvf
    conversations = files.select(F.try_parse_json("content").alias("v")).select(
        F.try_variant_get("v", "$.conversations", "variant").alias("list")
    )
    each = conversations.lateralJoin(table.variant_explode(F.col("list").outer()).select(F.col("value").alias("c")))
    turns = each.select(
        F.try_variant_get("c", "$.id", "string").alias("conv_id"),
        F.try_variant_get("c", "$.turns", "variant").alias("turns"),
    )
    rows = turns.lateralJoin(
        table.variant_explode(F.col("turns").outer()).select(
            (F.col("pos") + 1).alias("turn"), F.col("value").alias("t")
        )
    )
    return rows.select(
        "conv_id",
        "turn",
        *[F.try_variant_get("t", f"$.{field}", kind).alias(name) for name, (field, kind) in TURN_FIELDS.items()],
    )


def read_turn_cases(spark: SparkSession, path: str) -> DataFrame:
    """Conversation case files, each read whole."""
    return parse_turn_cases(
        spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))
    )


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per split. Tasks write their own rows, so texts aren't moved for it and a
    split that is most of the data is spread as the rows are."""
    rows.write.partitionBy("split").mode("errorifexists").json(path)


def read_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).json(path)


def write_titles(titles: DataFrame, path: str) -> None:
    """Lines are already tab-separated."""
    titles.write.mode("errorifexists").text(path)
