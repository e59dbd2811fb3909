"""Run telemetry and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import text as X
from yieldloom.operators.ranking import top_per_group

# Names of log steps, markers of the history format.
TOOL_STEP = "Function Call"
RETRIEVAL_STEPS = ("RAG 검색", "Knowledge 검색")
SUMMARY_HEADING = r"(?md)^#{1,4}\s*\d*\.?\s*요약\s*$"
NEXT_SECTION = r"(?md)^\s*(#{1,4}\s|---\s*$)"
SUMMARY_PREFIX = "(원인 분석 리포트 요약) "
CUT_MARK = "\n…(이하 생략)"
LATENCY_WINDOW = 100
RECENT_ROWS = 20


def with_calls(runs: DataFrame) -> DataFrame:
    """Tool and retrieval calls of each run from its log entries."""

    def entries(names: tuple[str, ...]) -> Column:
        return F.size(F.filter("log", lambda e: e["step"].isin(*names)))

    return runs.withColumn("fn_calls", entries((TOOL_STEP,))).withColumn(
        "rag_calls", entries(RETRIEVAL_STEPS)
    )


def kpi_totals(runs: DataFrame) -> DataFrame:
    """Queries, tool calls and retrieval calls per intent and in total."""
    return (
        runs.rollup("intent")
        .agg(
            F.when(F.grouping("intent") == 1, "total").otherwise(F.col("intent")).alias("scope"),
            F.count(F.lit(1)).alias("queries"),
            F.sum("fn_calls").alias("fn_calls"),
            F.sum("rag_calls").alias("rag_calls"),
        )
        .select("scope", "queries", "fn_calls", "rag_calls")
    )


def latest(runs: DataFrame, n: int) -> DataFrame:
    """Newest n runs; Spark keeps n rows per partition before they meet."""
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def kpi_latency(runs: DataFrame) -> DataFrame:
    """Mean and 95th percentile over the latest 100 runs."""
    window = latest(runs, LATENCY_WINDOW).agg(
        F.array_sort(F.collect_list("latency_ms")).alias("ms")
    )
    n = F.size("ms")
    total = F.aggregate("ms", F.lit(0).cast("long"), lambda acc, x: acc + x)
    at = F.floor(n * 0.95).cast("int")
    return window.select(
        n.alias("n"),
        F.when(n > 0, F.bround(total / n).cast("long")).otherwise(0).alias("avg_ms"),
        F.when(n >= 2, F.get("ms", at)).otherwise(0).alias("p95_ms"),
    )


def kpi_recent(runs: DataFrame) -> DataFrame:
    """The newest runs with their calls; logs are counted only for those."""
    return with_calls(latest(runs, RECENT_ROWS)).select(
        "run_id", "intent", "latency_ms", "fn_calls", "rag_calls"
    )


def intent_share(runs: DataFrame) -> DataFrame:
    """Rounded percent of runs per intent."""
    counts = runs.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("percent", F.bround(F.col("n") * 100 / total).cast("long"))


def report_summary(text: Column) -> Column:
    """Body of the summary section of a report; empty when there is none."""
    after = F.get(F.split(text, SUMMARY_HEADING, 2), F.lit(1))
    return F.coalesce(X.strip(F.get(F.split(after, NEXT_SECTION, 2), F.lit(0))), F.lit(""))


def cut_at_line(text: Column, max_chars: int) -> Column:
    """First characters of a text up to a line end."""
    head = F.substr(text, F.lit(1), F.lit(max_chars))
    return F.concat(F.regexp_replace(head, r"\n[^\n]*\z", ""), F.lit(CUT_MARK))


def compact_message(role: Column, text: Column, max_chars: int) -> Column:
    summary = report_summary(text)
    return (
        F.when(role != "assistant", text)
        .when(summary != "", F.concat(F.lit(SUMMARY_PREFIX), summary))
        .when(F.length(text) > max_chars, cut_at_line(text, max_chars))
        .otherwise(text)
    )


def compact_history(
    messages: DataFrame,
    max_messages: int = schemas.MAX_HISTORY_MESSAGES,
    max_chars: int = schemas.MAX_ANSWER_CHARS,
) -> DataFrame:
    """Shortened answers of the last messages; a cut history starts with a user turn.

    One message more than allowed is kept per conversation to see whether it was
    cut, so the windows here hold at most ``max_messages + 1`` rows.
    """
    tail = top_per_group(messages, ["conv_id"], [F.desc("turn")], max_messages + 1, "_back")
    conversation = Window.partitionBy("conv_id")
    was_cut = F.max("_back").over(conversation) > max_messages
    first_user = F.max(
        F.when((F.col("role") == "user") & (F.col("_back") <= max_messages), F.col("_back"))
    ).over(conversation)
    kept = (
        tail.withColumn("_cut", was_cut)
        .withColumn("_first", first_user)
        .filter(~F.col("_cut") | F.coalesce(F.col("_back") <= F.col("_first"), F.lit(False)))
    )
    return kept.select(
        "conv_id",
        "turn",
        "role",
        compact_message(F.col("role"), F.col("text"), max_chars).alias("text"),
    )


def context_size(messages: DataFrame, max_messages: int = schemas.MAX_HISTORY_MESSAGES) -> DataFrame:
    """Characters per conversation before and after compaction."""
    before = messages.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars_before"))
    after = compact_history(messages, max_messages).groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("chars_after")
    )
    return before.join(after, "conv_id", "left").withColumn(
        "chars_after", F.coalesce("chars_after", F.lit(0))
    )


def no_data_flag(results: DataFrame) -> DataFrame:
    """A result with an error, or with nothing but a message, holds no data."""
    keys = F.json_object_keys("result")
    empty = F.array_contains(keys, "error") | (keys == F.array(F.lit("message")))
    return results.withColumn("status", F.when(empty, "no_data").otherwise("ok"))
