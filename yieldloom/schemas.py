"""Fixed schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STRING_LIST = T.ArrayType(T.StringType())

STEPS = T.StructType(
    [
        T.StructField("lot_id", T.LongType()),
        T.StructField("step_seq", T.IntegerType()),
        T.StructField("step_name", T.StringType()),
        T.StructField("eqp_id", T.StringType()),
        T.StructField("in_qty", T.LongType()),
        T.StructField("reject", T.LongType()),
        T.StructField("out_qty", T.LongType()),
        T.StructField("yield_num", T.DoubleType()),
        T.StructField("track_out_time", T.TimestampNTZType()),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("lot_id", T.LongType()),
        T.StructField("eqp_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

SPECS = T.StructType(
    [
        T.StructField("recipe", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("min_text", T.StringType()),
        T.StructField("max_text", T.StringType()),
        T.StructField("active_flag", T.StringType()),
    ]
)

SECTION = T.StructType(
    [T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]
)

CAPTION = T.StructType(
    [
        T.StructField("section", T.IntegerType()),
        T.StructField("caption", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

CARD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("canonical_term", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("aliases", STRING_LIST),
        T.StructField("definition", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_doc", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("extracted_by", T.StringType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("context_header", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
    ]
)

QA_ROW = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "question",
            "answer",
            "question_type",
            "source_type",
            "source_id",
            "concept",
            "phrasing",
        )
    ]
)

# Fixed values.
MIN_ARTICLE_CHARS = 500
MAX_CHUNK_TOKENS = 500
TARGET_SUB_TOKENS = 450
RRF_K = 60
HYBRID_POOL = 20
MAX_HISTORY_MESSAGES = 12
MAX_ANSWER_CHARS = 900


def require_columns(df: DataFrame, schema: T.StructType, label: str) -> DataFrame:
    """Check on the driver that a table has the columns and types an operator relies on."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: {have.get(f.name, 'missing')}"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{label} does not match its schema ({', '.join(wrong)})")
    return df
