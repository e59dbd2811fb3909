from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import evals, qa, telemetry
from yieldloom.sources import corpus_files, tables
from yieldloom.sources.scratch import checkpoint_folder, scratch_path
from yieldloom.streaming import kpi


@pytest.fixture(scope="module")
def questions(spark):
    rows = []
    for kind, n in (("a", 1), ("b", 5), ("c", 25)):
        for i in range(n):
            rows += [(f"{kind}{i}", kind, "term", p, f"{kind}{i}{p}") for p in ("formal", "casual")]
    rows += [("c0", "c", "term", "formal", "shared"), ("b1", "b", "term", "formal", "shared")]
    return spark.createDataFrame(rows, "source_id string, source_type string, question_type string, phrasing string, question string")


def test_split_keeps_sources_whole(spark, questions):
    assignment = {r.source_id: r.split for r in qa.leakage_safe_split(questions).collect()}
    assert len(assignment) == 31
    assert assignment["c0"] == assignment["b1"] == "train"
    free = [s for s in assignment if s.startswith("c") and s != "c0"]
    counts = {k: sum(assignment[s] == k for s in free) for k in ("train", "valid", "test")}
    assert counts == {"train": 19, "valid": 2, "test": 3}
    rows = qa.apply_split(questions, qa.leakage_safe_split(questions))
    qa.check_split_total(questions, rows)
    again = {r.source_id: r.split for r in qa.leakage_safe_split(questions.repartition(1)).collect()}
    assert again == assignment
    report = {(r.split, r.dimension): r["rows"] for r in qa.split_report(rows).collect() if r.dimension == "all"}
    assert sum(report.values()) == questions.count()


def test_keyword_groups(spark):
    cases = spark.createDataFrame(
        [
            (1, "x", "x", "260329_STR_**01** and `edge`", [["260329_STR_01"], ["centre", "edge"]]),
            (2, "x", "x", "ML002", [["ML001"]]),
            (3, "y", "x", "ML001", [["ML001"]]),
        ],
        "case_id long, label string, expected_label string, answer string, expected_keywords array<array<string>>",
    )
    got = {r.case_id: (r.n_hits, r.misses, r.passed) for r in evals.keyword_recall(cases).collect()}
    assert got == {1: (2, "", True), 2: (0, "ML001", False), 3: (1, "", False)}


def test_turn_checks(spark):
    schema = (
        "conv_id long, turn int, label string, expect_label string, lot_id string, expect_lot_id string, tools array<string>, "
        "expect_tool string, calls array<map<string,string>>, expect_input map<string,string>, expect_words array<string>, answer string"
    )
    calls = [{"a": "1", "b": "1"}, {"a": "2"}]
    turns = spark.createDataFrame(
        [
            (1, 1, "d", "d", "L", "L", ["t"], "t", calls, {"a": "2", "b": "1"}, ["ok"], "all ok"),
            (1, 2, "d", "d", "L", None, ["t"], None, calls, None, None, ""),
            (2, 1, "d", "d", None, "L", [], "t", calls, {"a": "1", "c": "x"}, ["word"], "none"),
        ],
        schema,
    )
    checks = evals.turn_checks(turns)
    got = {(r.conv_id, r.turn): (r.passed, r.refs, r.refs_ok, r.inputs_ok, r.words_ok) for r in checks.collect()}
    assert got == {(1, 1): (True, 3, 3, 2, 1), (1, 2): (True, 0, 0, 0, 0), (2, 1): (False, 3, 0, 0, 0)}
    row = evals.conversation_pass(checks).first()
    assert (row.n_conversations, row.conversation_pass_rate, row.turn_pass_rate, row.reference_resolution) == (2, 0.5, 0.6667, 0.5)


def test_errors_are_not_scored_and_three_in_a_row_stop(spark):
    labels = {"a": "ok error error ok error ok", "b": "error error error ok", "c": "ok"}
    rows = [(run, dt.date(2026, 1, 1 + i // 2), i, label) for run, text in labels.items() for i, label in enumerate(text.split())]
    frame = spark.createDataFrame(rows, "run_id string, bucket date, seq int, label string")
    got = {r.run_id: (r.scored, r.errors, r.longest_error_run, r.stopped) for r in evals.error_run_filter(frame).collect()}
    assert got == {"a": (3, 3, 2, False), "b": (1, 3, 3, True), "c": (1, 0, 0, False)}
    assert {r.run_id for r in evals.scored_rows(frame).collect()} == {"a", "c"}


def test_judge_criteria_depend_on_the_event(spark):
    frame = spark.createDataFrame(
        [("strip_pattern", {"strip": True, "pattern": True, "cause_sound": True, "step": False}), ("x", {"step": True}), ("x", None)],
        "event_type string, verdict map<string,boolean>",
    )
    got = {r.criterion: (r.ok, r.total) for r in evals.judge_tally(frame).collect()}
    assert got == {"strip": (1, 1), "pattern": (1, 1), "cause_sound": (1, 2), "step": (1, 1), "equipment": (0, 1), "defect": (0, 1), "all": (1, 2)}


@pytest.mark.parametrize(("n", "p95"), [(1, 0), (2, 1), (100, 95), (150, 145)])
def test_latency_of_the_latest_hundred(spark, n, p95):
    runs = spark.range(n).select(F.col("id").alias("run_id"), F.col("id").alias("ts"), F.col("id").alias("latency_ms"))
    row = telemetry.kpi_latency(runs).first()
    assert (row.n, row.p95_ms) == (min(n, 100), p95)


def history(spark, roles, texts=None):
    texts = texts or ["t"] * len(roles)
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))], "conv_id long, turn int, role string, text string")


def kept(frame, **options):
    return [(r.turn, r.text) for r in telemetry.compact_history(frame, **options).orderBy("turn").collect()]


def test_report_is_reduced_to_its_summary(spark):
    report = "# R\n\n## 1. 요약\n\nCause: mold\nLot 5\n\n---\n## 2. more\nx"
    open_end = "### 요약\nlast section"
    empty = "## 요약\n## next\nx"
    got = kept(history(spark, ["assistant", "assistant", "assistant", "user"], [report, open_end, empty, report]))
    assert [t for _, t in got] == [
        "(원인 분석 리포트 요약) Cause: mold\nLot 5", "(원인 분석 리포트 요약) last section", empty, report,
    ]


def test_long_answers_are_cut_at_a_line(spark):
    lines = "a" * 500 + "\n" + "b" * 300 + "\n" + "c" * 500
    got = kept(history(spark, ["assistant", "assistant"], [lines, "x" * 1000]))
    assert got[0][1] == "a" * 500 + "\n" + "b" * 300 + "\n…(이하 생략)"
    assert got[1][1] == "x" * 900 + "\n…(이하 생략)"


def test_only_a_cut_history_starts_with_a_user_turn(spark):
    short = history(spark, ["assistant", "user"])
    assert [t for t, _ in kept(short)] == [0, 1]
    long = history(spark, ["user", "assistant"] * 6 + ["user"])
    assert [t for t, _ in kept(long)] == list(range(2, 13))
    assert kept(history(spark, ["system"] * 13)) == []


def test_no_data(spark):
    rows = ['{"error": 1, "x": 2}', '{"message": "m"}', '{"message": "m", "r": 1}', '{"a": 1}', "text"]
    frame = spark.createDataFrame([(r,) for r in rows], "result string")
    assert [r.status for r in telemetry.no_data_flag(frame).collect()] == ["no_data", "no_data", "ok", "ok", "ok"]


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = kpi.start_totals(tables.runs_from_events(source), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = {tuple(r) for r in kpi.read_totals(spark, str(tmp_path / "out")).collect()}
    batch = telemetry.kpi_totals(telemetry.with_calls(tables.runs_from_events(events)))
    assert got == {tuple(r) for r in batch.filter("scope <> 'total'").collect()}


def test_stream_totals_leave_two_folders_and_take_a_trigger(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert kpi.read_totals(spark, out).collect() == []
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = kpi.start_totals(tables.runs_from_events(source), out, state, trigger={"processingTime": "0 seconds"})
    query.processAllAvailable()
    query.stop()
    assert kpi.batches(spark, out) == [3, 4]
    batch = telemetry.kpi_totals(telemetry.with_calls(tables.runs_from_events(events)))
    assert {tuple(r) for r in kpi.read_totals(spark, out).collect()} == {tuple(r) for r in batch.filter("scope <> 'total'").collect()}


def test_streamed_windows_equal_the_batch_figures_in_any_order(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # Newest first, so that the first file already holds most of the answer; one run comes twice.
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
    parts = [newest, events.filter("event_id % 3 = 1"), events.filter("event_id % 3 = 0"), events.filter("event_id % 3 = 2")]
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    whole = tables.runs_from_events(events.unionByName(newest))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    runs = tables.runs_from_events(source)
    assert kpi.read_latest(spark, out, runs).count() == 0
    kpi.start_latest(runs, out, state).awaitTermination()
    kept = kpi.read_latest(spark, out, runs)
    assert len(kpi.batches(spark, out)) == 2 and kept.count() == 100
    assert telemetry.kpi_latency(kept).collect() == telemetry.kpi_latency(whole).collect()
    assert sorted(telemetry.kpi_recent(kept).collect()) == sorted(telemetry.kpi_recent(whole).collect())


def test_a_repeated_batch_counts_nothing_twice(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), tmp_path / "state"
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs = tables.runs_from_events(source)
    kpi.start_latest(runs, out, str(state)).awaitTermination()
    first = sorted(kpi.read_latest(spark, out, runs).collect(), key=str)
    # As if the job had been lost after the last table was written, before the batch was noted.
    last = max(kpi.batches(spark, out))
    (state / "commits" / str(last)).unlink()
    (state / "commits" / f".{last}.crc").unlink(missing_ok=True)
    kpi.start_latest(runs, out, str(state)).awaitTermination()
    assert sorted(kpi.read_latest(spark, out, runs).collect(), key=str) == first


def test_a_row_without_a_split_ends_the_job(spark, questions):
    assignment = qa.leakage_safe_split(questions).filter("source_id <> 'c3'")
    with pytest.raises(Exception, match="no split for source c3"):
        qa.apply_split(questions, assignment).collect()


def test_scratch_is_below_the_session_checkpoint_folder(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_folder(spark))


def test_error_rows_without_a_time_still_count(spark):
    frame = spark.createDataFrame(
        [("r", "b", 1, "ok"), ("r", None, 2, "error"), ("r", None, 3, "error")], "run_id string, bucket string, seq int, label string"
    )
    got = evals.error_run_filter(frame).first()
    assert (got.scored, got.errors, got.longest_error_run) == (1, 2, 2)


def test_sources_without_type_or_name_keep_their_rows(spark):
    rows = spark.createDataFrame(
        [("a", None, "q1"), ("b", "card", "q2"), (None, "card", "q3")], "source_id string, source_type string, question string"
    )
    out = qa.apply_split(rows, qa.leakage_safe_split(rows))
    qa.check_split_total(rows, out)
    assert out.columns == [*rows.columns, "split"]


def test_turn_case_files_are_read_back(spark, tmp_path):
    case = {
        "description": "x",
        "conversations": [
            {
                "id": "MT-1",
                "turns": [
                    {"query": "which?", "expect_intent": "data", "expect_tool": "t", "expect_answer_contains": ["M1", "M2"]},
                    {"query": "and its \"first\"\nlot?", "expect_intent": "data", "expect_lot_id": "L7", "expect_tool_input": {"eqp": "M1", "n": 5}},
                ],
            },
            {"id": "MT-2", "turns": []},
            {"id": "MT-3"},
            {"id": "MT-4", "turns": [{"query": "é", "expect_intent": "none", "expect_answer_contains": []}]},
        ],
    }
    for name, text in {"a": json.dumps(case, indent=2), "b": "no json", "c": "{}", "d": ""}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = [tuple(r) for r in corpus_files.read_turn_cases(spark, str(tmp_path)).orderBy("conv_id", "turn").collect()]
    assert got == [
        ("MT-1", 1, "which?", "data", None, "t", None, ["M1", "M2"]),
        ("MT-1", 2, 'and its "first"\nlot?', "data", "L7", None, {"eqp": "M1", "n": "5"}, None),
        ("MT-4", 1, "é", "none", None, None, None, []),
    ]


def test_a_split_is_written_without_moving_texts(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from yieldloom.sources import corpus_files

    hints = []
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *rest: hints.append(name) or self)
    rows = spark.createDataFrame([("a", "q", "train"), ("b", None, "test")], "source_id string, question string, split string")
    corpus_files.write_splits(rows, str(tmp_path / "s"))
    assert "rebalance" not in hints
    back = corpus_files.read_splits(spark, str(tmp_path / "s"), rows.drop("split").schema).collect()
    assert sorted((r.source_id, r.question, r.split) for r in back) == [("a", "q", "train"), ("b", None, "test")]
