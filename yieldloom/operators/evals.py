"""Scoring of stored predictions against answer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import text as X
from yieldloom.operators.ranking import running_total, top_per_group

# Judged criteria per event type, accepted wording of strip patterns.
CRITERIA = {"strip_pattern": ("strip", "pattern", "cause_sound")}
DEFAULT_CRITERIA = ("step", "equipment", "defect", "cause_sound")
ALL_CRITERIA = "all"
MAX_CONSECUTIVE_ERRORS = 3
PATTERN_WORDING = {
    "center": ["중앙 집중", "중앙 집중형", "Center Cluster"],
    "edge": ["가장자리 분포", "가장자리 집중", "에지 집중", "엣지 집중", "Edge Concentration"],
    "stripe": ["라인·스트라이프", "라인/스트라이프", "스트라이프형", "Line/Stripe"],
    "scattered": ["산발 분포", "랜덤 산발", "산발 분포형", "Random Distribution"],
}


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.when(whole > 0, whole), 4)


def label_accuracy(rows: DataFrame) -> DataFrame:
    """Correct labels overall and per expected label, in one pass."""
    return (
        rows.groupingSets([[], [F.col("expected")]], "expected")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("expected") == F.col("got")).alias("ok"),
            F.when(F.grouping("expected") == 1, "overall").otherwise(F.col("expected")).alias("label"),
        )
        .select("label", "n", "ok", share(F.col("ok"), F.col("n")).alias("accuracy"))
    )


def tool_choice_accuracy(rows: DataFrame) -> DataFrame:
    """Any expected tool was called; only data questions with expectations are counted."""
    counted = (F.size("expected_tools") > 0) & (F.col("label") == "data")
    hit = counted & F.arrays_overlap("expected_tools", "called_tools")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == F.col("expected_label")).alias("label_ok"),
        F.count_if(counted).alias("tool_total"),
        F.count_if(hit).alias("tool_ok"),
    ).withColumn("tool_accuracy", share(F.col("tool_ok"), F.col("tool_total")))


def verify_defect_cases(
    events: DataFrame,
    event_lots: DataFrame,
    defects: DataFrame,
    violations: DataFrame,
    per_event: int = 3,
) -> DataFrame:
    """Lots of an event whose data agree with its answer key; the first few per event.

    ``event_lots`` is in long form (event_id, place, lot_id), so an event may
    name any number of lots.
    """
    found = defects.select(
        "lot_id",
        F.col("step_name").alias("step"),
        "eqp_id",
        F.col("defect_type").alias("defect_name"),
    )
    items = (
        violations.select("lot_id", F.col("key").alias("root_cause_item"))
        .distinct()
        .withColumn("violated", F.lit(True))
    )
    agreeing = event_lots.join(events, "event_id").join(
        found, ["lot_id", "step", "eqp_id", "defect_name"], "left_semi"
    )
    verified = agreeing.join(items, ["lot_id", "root_cause_item"], "left").filter(
        F.col("root_cause_item").isNull() | F.col("violated")
    )
    picked = top_per_group(verified, ["event_id"], ["place", "lot_id"], per_event, "case_no")
    any_of = F.concat(
        F.array(F.array("step"), F.array("eqp_id"), X.defect_name_variants(F.col("defect_name"))),
        F.when(F.col("root_cause_item").isNotNull(), F.array(F.array("root_cause_item"))).otherwise(
            F.array().cast("array<array<string>>")
        ),
    )
    return picked.select(
        "event_id",
        F.concat_ws("-", "event_id", "case_no").alias("case_id"),
        "lot_id",
        any_of.alias("expected_keywords"),
    )


def verify_strip_cases(
    events: DataFrame, event_lots: DataFrame, worst_strips: DataFrame, per_event: int = 3
) -> DataFrame:
    """Lots of a strip event whose worst strip shows the planted pattern."""
    worst = worst_strips.select("lot_id", "strip_id", "pattern")
    verified = event_lots.join(events.select("event_id", "pattern"), "event_id").join(
        worst, ["lot_id", "pattern"]
    )
    wording = F.create_map(
        *[
            part
            for pattern, words in PATTERN_WORDING.items()
            for part in (F.lit(pattern), F.array(*map(F.lit, words)))
        ]
    )
    picked = top_per_group(verified, ["event_id"], ["place", "lot_id"], per_event, "case_no")
    words = F.coalesce(F.try_element_at(wording, F.col("pattern")), F.array("pattern"))
    return picked.select(
        "event_id",
        F.concat_ws("-", "event_id", "case_no").alias("case_id"),
        "lot_id",
        F.array(F.array(F.col("strip_id").cast("string")), words).alias("expected_keywords"),
    )


def without_emphasis(text: Column) -> Column:
    """Emphasis marks go; underscores are part of identifiers and stay."""
    return F.translate(text, "*`", "")


def keyword_recall(cases: DataFrame) -> DataFrame:
    """Which any-of keyword groups the answer contains; all of them and the label pass."""
    answer = without_emphasis(F.coalesce("answer", F.lit("")))

    def hit(group: Column) -> Column:
        return F.exists(group, lambda word: F.contains(answer, without_emphasis(word)))

    misses = F.filter("expected_keywords", lambda group: ~hit(group))
    label_ok = F.coalesce(F.col("label") == F.col("expected_label"), F.lit(False))
    return (
        cases.withColumn("misses", misses)
        .withColumn("label_ok", label_ok)
        .withColumn("n_keywords", F.size("expected_keywords"))
        .withColumn("n_hits", F.col("n_keywords") - F.size("misses"))
        .withColumn("passed", F.col("label_ok") & (F.size("misses") == 0))
        .withColumn("misses", F.array_join(F.transform("misses", lambda g: F.get(g, F.lit(0))), ","))
    )


def eval_summary(scored: DataFrame) -> DataFrame:
    """Rates overall and per event type; keyword recall is over keywords, not cases."""
    return (
        scored.groupingSets([[], [F.col("event_type")]], "event_type")
        .agg(
            F.when(F.grouping("event_type") == 1, "overall").otherwise(F.col("event_type")).alias("scope"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("label_ok").alias("label_ok"),
            F.count_if("passed").alias("passed"),
            F.count_if("cited").alias("cited"),
            F.sum("n_hits").alias("hits"),
            F.sum("n_keywords").alias("keywords"),
        )
        .select(
            "scope",
            "n",
            "passed",
            share(F.col("label_ok"), F.col("n")).alias("label_accuracy"),
            share(F.col("hits"), F.col("keywords")).alias("keyword_recall"),
            share(F.col("passed"), F.col("n")).alias("pass_rate"),
            share(F.col("cited"), F.col("n")).alias("citation_rate"),
        )
    )


def judge_tally(verdicts: DataFrame) -> DataFrame:
    """True verdicts per criterion, each counted only for the event types it belongs to."""
    criteria = F.array(*map(F.lit, DEFAULT_CRITERIA))
    for event_type, names in CRITERIA.items():
        criteria = F.when(
            F.col("event_type") == event_type, F.array(*map(F.lit, names))
        ).otherwise(criteria)

    def true(name: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("verdict"), name), F.lit(False))

    marks = F.transform(criteria, lambda c: F.struct(c.alias("criterion"), true(c).alias("ok")))
    everything = F.struct(F.lit(ALL_CRITERIA).alias("criterion"), F.forall(criteria, true).alias("ok"))
    return (
        verdicts.filter(F.col("verdict").isNotNull())
        .select(F.inline(F.concat(marks, F.array(everything))))
        .groupBy("criterion")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"))
        .withColumn("rate", share(F.col("ok"), F.col("total")))
    )


def turn_checks(turns: DataFrame) -> DataFrame:
    """Checks of one conversation turn; an expectation that is null is not checked.

    Arguments of several tool calls are merged: the last call that sets a name wins.
    """

    def argument(name: Column) -> Column:
        setting = F.filter("calls", lambda call: F.map_contains_key(call, name))
        return F.try_element_at(F.try_element_at(setting, F.lit(-1)), name)

    def checked(expectation: Column, ok: Column) -> Column:
        return F.when(expectation.isNotNull(), F.coalesce(ok, F.lit(False)))

    wanted = F.coalesce(F.map_entries("expect_input"), F.array().cast("array<struct<key:string,value:string>>"))
    words = F.coalesce("expect_words", F.array().cast("array<string>"))
    right = F.filter(wanted, lambda e: F.coalesce(argument(e["key"]) == e["value"], F.lit(False)))
    spoken = F.filter(words, lambda w: F.contains(F.col("answer"), w))
    scored = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("label") == F.col("expect_label"), F.lit(False)).alias("label_ok"),
        checked(F.col("expect_lot_id"), F.col("lot_id") == F.col("expect_lot_id")).alias("lot_ok"),
        checked(F.col("expect_tool"), F.array_contains("tools", F.col("expect_tool"))).alias("tool_ok"),
        F.size(wanted).alias("inputs"),
        F.size(right).alias("inputs_ok"),
        F.size(words).alias("words"),
        F.size(spoken).alias("words_ok"),
    )
    reference = F.when(F.col("lot_ok").isNotNull(), 1).otherwise(0)
    return scored.select(
        "*",
        (reference + F.col("inputs")).alias("refs"),
        (F.when(F.col("lot_ok"), 1).otherwise(0) + F.col("inputs_ok")).alias("refs_ok"),
        (
            F.col("label_ok")
            & F.coalesce("lot_ok", F.lit(True))
            & F.coalesce("tool_ok", F.lit(True))
            & (F.col("inputs") == F.col("inputs_ok"))
            & (F.col("words") == F.col("words_ok"))
        ).alias("passed"),
    )


def conversation_pass(checks: DataFrame) -> DataFrame:
    """A conversation passes when all its turns do; rates over conversations, turns, references."""
    per_conversation = checks.groupBy("conv_id").agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).alias("turns"),
        F.count_if("passed").alias("turns_ok"),
        F.count_if("label_ok").alias("labels_ok"),
        F.sum("refs").alias("refs"),
        F.sum("refs_ok").alias("refs_ok"),
    )
    totals = per_conversation.agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.count_if("passed").alias("conversations_ok"),
        F.sum("turns").alias("n_turns"),
        F.sum("turns_ok").alias("turns_ok"),
        F.sum("labels_ok").alias("labels_ok"),
        F.sum("refs").alias("refs"),
        F.sum("refs_ok").alias("refs_ok"),
    )
    return totals.select(
        "n_conversations",
        "n_turns",
        share(F.col("labels_ok"), F.col("n_turns")).alias("label_accuracy"),
        share(F.col("refs_ok"), F.col("refs")).alias("reference_resolution"),
        share(F.col("turns_ok"), F.col("n_turns")).alias("turn_pass_rate"),
        share(F.col("conversations_ok"), F.col("n_conversations")).alias("conversation_pass_rate"),
    )


def error_run_filter(results: DataFrame) -> DataFrame:
    """Per run: scored rows, error rows, longest row of errors, and whether it stopped the run.

    ``results`` has (run_id, bucket, seq, label), where buckets cut a run into
    ordered pieces such as hours. Errors with the same number of other rows
    before them form one stretch; the count is carried over buckets, so a long
    run is not sorted by one task.
    """
    marked = results.withColumn("fine", F.when(F.col("label") == "error", 0).otherwise(1).cast("long"))
    counted = running_total(marked, ["run_id"], ["bucket"], ["seq"], "fine", "stretch")
    stretches = counted.groupBy("run_id", "stretch").agg(
        F.sum("fine").alias("scored"), F.count_if(F.col("fine") == 0).alias("errors")
    )
    return (
        stretches.groupBy("run_id")
        .agg(
            F.sum("scored").alias("scored"),
            F.sum("errors").alias("errors"),
            F.max("errors").alias("longest_error_run"),
        )
        .withColumn("stopped", F.col("longest_error_run") >= MAX_CONSECUTIVE_ERRORS)
    )


def scored_rows(results: DataFrame) -> DataFrame:
    """Rows that count: no infrastructure errors, no rows of stopped runs."""
    stopped = error_run_filter(results).filter("stopped").select("run_id")
    return results.filter(F.col("label") != "error").join(stopped, "run_id", "left_anti")
