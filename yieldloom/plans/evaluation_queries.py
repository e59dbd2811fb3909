"""Registered question-set, scoring and telemetry analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.operators import evals, qa, specs, telemetry, yields
from yieldloom.operators.joins import broadcast_if_small
from yieldloom.plans import yield_queries
from yieldloom.plans.yield_queries import (
    DEFECT_SQL,
    DIES_SQL,
    READINGS_SQL,
    STEPS_SQL,
    WORST_SQL,
)
from yieldloom.sources import corpus_files, tables
from yieldloom.sources.scratch import scratch_path
from yieldloom.streaming import kpi

SHORT_HISTORY = 4


def _groups(column: str) -> F.Column:
    """[['a', 'b'], ['c']] as 'a|b,c'."""
    return F.array_join(F.transform(column, lambda g: F.array_join(g, "|")), ",")


def qa_pending(spark: SparkSession, folder: str) -> DataFrame:
    return qa.qa_pending(
        tables.qa_sources(spark, folder),
        qa.normalize_question_types(tables.qa_rows(spark, folder)),
    )


def ambiguous_questions(spark: SparkSession, folder: str) -> DataFrame:
    return qa.ambiguous_questions(tables.qa_rows(spark, folder))


def leakage_safe_split(spark: SparkSession, folder: str) -> DataFrame:
    return qa.leakage_safe_split(tables.qa_rows(spark, folder))


def _split_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = qa.normalize_question_types(tables.qa_rows(spark, folder))
    return qa.apply_split(rows, qa.leakage_safe_split(rows))


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    return qa.split_report(_split_rows(spark, folder))


def write_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per split as read back from the written files."""
    path = scratch_path(spark, "splits")
    corpus_files.write_splits(_split_rows(spark, folder), path)
    return (
        corpus_files.read_splits(spark, path, schemas.QA_ROW)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source_id").alias("sources"))
    )


def train_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with the digest of the text, taken once per source before the join."""
    digests = tables.qa_sources(spark, folder).withColumn("text", F.md5("text"))
    pairs = qa.train_pairs(tables.qa_rows(spark, folder), digests, phrasing="formal")
    return pairs.withColumnRenamed("positive", "positive_md5")


def read_eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus_files.parse_eval_cases(tables.eval_case_files(spark, folder))
    return rows.select(
        "id",
        "query",
        "expected_intent",
        F.array_join("expected_tools", "|").alias("expected_tools"),
        _groups("expected_keywords").alias("expected_keywords"),
    )


def label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evals.label_accuracy(tables.classified_events(spark, folder))


def tool_choice_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evals.tool_choice_accuracy(tables.tool_cases(spark, folder))


def verify_defect_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Worst steps, labels and violations of the lots and items that events name, no others."""
    events = tables.defect_events(spark, folder)
    event_lots = tables.defect_event_lots(spark, folder)
    lots = broadcast_if_small(event_lots.select("lot_id").distinct())
    readings = tables.readings(spark, folder).join(lots, "lot_id", "left_semi")
    items = broadcast_if_small(events.select(F.col("root_cause_item").alias("key")).distinct())
    violations = specs.spec_violations(
        readings.join(items, "key", "left_semi"),
        tables.recipe_mapping(spark, folder).join(lots, "lot_id", "left_semi"),
        specs.check_spec_keys(tables.recipe_specs(spark)),
    )
    defects = yields.lot_defect_type(
        tables.lot_steps(spark, folder).join(lots, "lot_id", "left_semi"), readings
    )
    rows = evals.verify_defect_cases(events, event_lots, defects, violations)
    return rows.withColumn("expected_keywords", _groups("expected_keywords"))


def verify_strip_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = evals.verify_strip_cases(
        tables.strip_events(spark, folder),
        tables.strip_event_lots(spark, folder),
        yield_queries.lot_worst_strip(spark, folder),
    )
    return rows.withColumn("expected_keywords", _groups("expected_keywords"))


def keyword_recall(spark: SparkSession, folder: str) -> DataFrame:
    return evals.keyword_recall(tables.answer_cases(spark, folder)).select(
        "case_id", "n_keywords", "n_hits", "misses", "label_ok", "passed"
    )


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evals.eval_summary(evals.keyword_recall(tables.answer_cases(spark, folder)))


def judge_tally(spark: SparkSession, folder: str) -> DataFrame:
    return evals.judge_tally(tables.judge_verdicts(spark, folder))


def turn_checks(spark: SparkSession, folder: str) -> DataFrame:
    return evals.turn_checks(tables.conversation_turns(spark, folder))


def file_turn_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The checks with what is expected read from case files, which are written and read back."""
    path = scratch_path(spark, "cases")
    tables.turn_case_files(spark, folder).write.text(path)
    cases = corpus_files.parse_turn_cases(spark.read.text(path).select(F.col("value").alias("content")))
    answers = tables.answered_turns(spark, folder).drop(*[c for c in cases.columns if c.startswith("expect_")])
    joined = answers.alias("a").join(
        cases.alias("c"),
        (F.col("a.conv_id").cast("string") == F.col("c.conv_id")) & (F.col("a.place") == F.col("c.turn")),
    )
    expected = [f"c.{c}" for c in cases.columns if c.startswith("expect_")]
    return evals.turn_checks(joined.select("a.*", *expected))


def conversation_pass(spark: SparkSession, folder: str) -> DataFrame:
    return evals.conversation_pass(turn_checks(spark, folder))


def error_run_filter(spark: SparkSession, folder: str) -> DataFrame:
    return evals.error_run_filter(tables.run_results(spark, folder))


def kpi_totals(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.kpi_totals(telemetry.with_calls(tables.logged_runs(spark, folder)))


def kpi_latency(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.kpi_latency(tables.runs(spark, folder))


def kpi_recent(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.kpi_recent(tables.runs(spark, folder))


def kpi_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table read as a stream until all of it has been counted."""
    path = scratch_path(spark, "kpi-totals")
    query = kpi.start_totals(
        tables.streamed_runs(spark, folder), path, scratch_path(spark, "kpi-checkpoint")
    )
    query.awaitTermination()
    return kpi.read_totals(spark, path)


def _streamed_latest(spark: SparkSession, folder: str) -> DataFrame:
    path, runs = scratch_path(spark, "kpi-latest"), tables.streamed_runs(spark, folder)
    kpi.start_latest(runs, path, scratch_path(spark, "kpi-checkpoint")).awaitTermination()
    return kpi.read_latest(spark, path, runs)


def kpi_stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Latency figures from the runs that a stream has kept."""
    return telemetry.kpi_latency(_streamed_latest(spark, folder))


def kpi_stream_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The newest runs from those that a stream has kept."""
    return telemetry.kpi_recent(_streamed_latest(spark, folder))


def intent_share(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.intent_share(tables.runs(spark, folder))


def compact_history(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.compact_history(tables.messages(spark, folder))


def compact_short_history(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.compact_history(tables.messages(spark, folder), SHORT_HISTORY)


def context_size(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.context_size(tables.messages(spark, folder), SHORT_HISTORY)


def no_data_flag(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.no_data_flag(tables.tool_results(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        qa_pending,
        ambiguous_questions,
        leakage_safe_split,
        split_report,
        write_splits,
        train_pairs,
        read_eval_cases,
        label_accuracy,
        tool_choice_accuracy,
        verify_defect_cases,
        verify_strip_cases,
        keyword_recall,
        eval_summary,
        judge_tally,
        turn_checks,
        file_turn_checks,
        conversation_pass,
        error_run_filter,
        kpi_totals,
        kpi_latency,
        kpi_recent,
        kpi_stream,
        kpi_stream_latency,
        kpi_stream_recent,
        intent_share,
        compact_history,
        compact_short_history,
        context_size,
        no_data_flag,
    )
}

SOURCES_SQL = """sources AS (
  SELECT CASE WHEN lang = 'en' THEN 'card-' ELSE 'chunk-' END || doc_id AS source_id,
         CASE WHEN lang = 'en' THEN 'glossary_card' ELSE 'article_chunk' END AS source_type,
         CASE WHEN lang = 'en' THEN 'term' WHEN lang = 'fr' THEN 'flow' WHEN lang = 'de' THEN 'judgment'
              ELSE 'concept' END AS question_type,
         doc_id, text, n_chars >= 300 AS formal, source <> 'src3' AS casual FROM documents),
lines AS (SELECT *, unnest(string_split(text, chr(10))) AS line FROM sources),
qa AS (
  SELECT source_id, source_type, question_type, line AS question, 'formal' AS phrasing, text
  FROM lines WHERE formal
  UNION ALL SELECT source_id, source_type, question_type, line || '?', 'casual', text
  FROM lines WHERE casual),
ambiguous AS (
  SELECT question, count(DISTINCT source_id) AS n_sources, min(source_id) AS first_source
  FROM qa GROUP BY question HAVING count(DISTINCT source_id) > 1)"""

SPLIT_SQL = f"""{SOURCES_SQL},
ids AS (
  SELECT source_id, min(source_type) AS source_type,
         bool_or(question IN (SELECT question FROM ambiguous)) AS forced FROM qa GROUP BY source_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY md5('42:' || source_id), source_id)
           AS place,
         count(*) OVER (PARTITION BY source_type) AS n FROM ids WHERE NOT forced),
assigned AS (
  SELECT source_id, 'train' AS split FROM ids WHERE forced
  UNION ALL
  SELECT source_id,
         CASE WHEN place <= round_even(n * 0.8e0, 0) THEN 'train'
              WHEN place <= round_even(n * 0.8e0, 0)
                   + least(round_even(n * 0.1e0, 0), n - round_even(n * 0.8e0, 0)) THEN 'valid'
              ELSE 'test' END FROM placed),
split_rows AS (SELECT * FROM qa JOIN assigned USING (source_id))"""

ANSWERS_SQL = """answers AS (
  SELECT doc_id AS case_id, source AS event_type, replace(replace(text, '*', ''), '`', '') AS a,
         contains(text, 'and ') AS cited,
         lang = CASE WHEN n_chars < 200 THEN 'de' ELSE 'en' END AS label_ok FROM documents),
hits AS (
  SELECT *, contains(a, 'the ') OR contains(a, 'der ') OR contains(a, 'que ') AS h1,
         contains(a, 'the') AS h2, contains(a, 'on') OR contains(a, 'nothing') AS h3 FROM answers),
scored AS (
  SELECT *, 3 AS n_keywords, h1::INT + h2::INT + h3::INT AS n_hits,
         concat_ws(',', CASE WHEN NOT h1 THEN 'the ' END, CASE WHEN NOT h2 THEN '*the*' END,
                   CASE WHEN NOT h3 THEN 'on' END) AS misses,
         label_ok AND h1 AND h2 AND h3 AS passed FROM hits)"""

TURNS_SQL = """turns AS (
  SELECT conv_id, turn, length(text) <= 300 AS label_ok,
         CASE WHEN turn > 1 THEN length(text) <= 300 END AS lot_ok,
         CASE WHEN turn < 3 THEN length(text) <= 300 END AS tool_ok,
         CASE WHEN turn > 1 THEN 2 ELSE 0 END AS inputs,
         CASE WHEN turn > 1 THEN 1 + (conv_id = turn)::INT ELSE 0 END AS inputs_ok,
         2 AS words, contains(text, 'e')::INT + contains(text, 'the')::INT AS words_ok
  FROM conversations WHERE role = 'assistant'),
checks AS (
  SELECT *, inputs + (lot_ok IS NOT NULL)::INT AS refs,
         inputs_ok + coalesce(lot_ok, false)::INT AS refs_ok,
         label_ok AND coalesce(lot_ok, true) AND coalesce(tool_ok, true) AND inputs = inputs_ok
           AND words = words_ok AS passed FROM turns)"""

RUNS_SQL = """runs AS (
  SELECT event_id AS run_id, ts, event_type AS intent, round_even(value, 0)::BIGINT AS latency_ms,
         (CAST(props->>'k' AS INT) + 2) // 3 AS fn_calls, CAST(props->>'k' AS INT) // 3 AS rag_calls
  FROM events),
newest AS (SELECT *, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS back FROM runs)"""


def history_sql(limit: int) -> str:
    return f"""texts AS (
  SELECT conv_id, turn, role, text AS raw,
         role = 'assistant' AND length(text) BETWEEN 300 AND 600 AS report,
         length(text) + CASE WHEN role = 'assistant' AND length(text) BETWEEN 300 AND 600 THEN
           length('# Report' || chr(10) || '## 1. 요약' || chr(10)
                  || string_split(text, chr(10))[1] || chr(10) || 'second line' || chr(10) || chr(10)
                  || '---' || chr(10) || '## 2. Detail' || chr(10)) ELSE 0 END AS chars
  FROM conversations),
short AS (
  SELECT *, CASE WHEN report THEN '(원인 분석 리포트 요약) '
                   || ltrim(string_split(raw, chr(10))[1]) || chr(10) || 'second line'
                 WHEN role = 'assistant' AND length(raw) > 900 THEN
                   CASE WHEN contains(left(raw, 900), chr(10))
                        THEN left(raw, 900 - strpos(reverse(left(raw, 900)), chr(10)))
                        ELSE left(raw, 900) END || chr(10) || '…(이하 생략)'
                 ELSE raw END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
         count(*) OVER (PARTITION BY conv_id) AS total FROM texts),
compact AS (
  SELECT * FROM short s
  WHERE total <= {limit}
     OR back <= (SELECT max(back) FROM short u
                 WHERE u.conv_id = s.conv_id AND u.role = 'user' AND u.back <= {limit}))"""


ORACLES = {
    "qa_pending": f"""WITH {SOURCES_SQL}
SELECT source_id, source_type, NOT formal AS needs_formal, NOT casual AS needs_casual,
  CASE WHEN formal OR casual OR source_type = 'glossary_card' THEN question_type END AS question_type,
  (doc_id % 6)::INT AS style FROM sources WHERE NOT (formal AND casual)""",
    "ambiguous_questions": f"WITH {SOURCES_SQL} SELECT * FROM ambiguous",
    "leakage_safe_split": f"WITH {SPLIT_SQL} SELECT * FROM assigned",
    "split_report": f"""WITH {SPLIT_SQL}, long AS (
  SELECT split, source_id, 'all' AS dimension, '' AS value FROM split_rows
  UNION ALL SELECT split, source_id, 'source_type', source_type FROM split_rows
  UNION ALL SELECT split, source_id, 'question_type', question_type FROM split_rows
  UNION ALL SELECT split, source_id, 'phrasing', phrasing FROM split_rows)
SELECT split, dimension, value, count(*) AS rows, count(DISTINCT source_id) AS sources
FROM long GROUP BY ALL""",
    "write_splits": f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS rows, count(DISTINCT source_id) AS sources FROM split_rows GROUP BY split""",
    "train_pairs": f"""WITH {SOURCES_SQL}
SELECT question AS query, md5(text) AS positive_md5 FROM qa WHERE phrasing = 'formal'""",
    "read_eval_cases": """WITH w AS (
  SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark)
SELECT 'c' || item_id AS id, 'q' AS query, 'data' AS expected_intent, 'a|b' AS expected_tools,
  array_to_string([CASE WHEN i = 1 THEN '' WHEN i % 3 = 0 THEN '|' ELSE ',' END || w[i]
                   FOR i IN range(1, len(w) + 1)], '') AS expected_keywords FROM w""",
    "label_accuracy": """WITH l AS (
  SELECT event_type AS label, (value >= 20 OR event_type = 'error')::INT AS hit FROM events
  UNION ALL SELECT 'overall', (value >= 20 OR event_type = 'error')::INT FROM events)
SELECT label, count(*) AS n, sum(hit)::BIGINT AS ok, round(sum(hit) * 1e0 / count(*), 4) AS accuracy
FROM l GROUP BY label""",
    "tool_choice_accuracy": """WITH c AS (
  SELECT event_type, value < 50 AS data, CAST(props->>'k' AS INT) AS k FROM events),
h AS (SELECT *, data AND event_type <> 'error' AS counted,
  CASE WHEN event_type = 'view' THEN k < 60 ELSE k >= 30 AND k < 60 END AS hit FROM c)
SELECT count(*) AS n, count(*) FILTER (data = (event_type <> 'error')) AS label_ok,
  count(*) FILTER (counted) AS tool_total, count(*) FILTER (counted AND hit) AS tool_ok,
  round(count(*) FILTER (counted AND hit) * 1e0 / count(*) FILTER (counted), 4) AS tool_accuracy FROM h""",
    "verify_defect_cases": f"""WITH {STEPS_SQL}, {WORST_SQL}, {READINGS_SQL}, {DEFECT_SQL},
ok AS (
  SELECT DISTINCT 'EV' || s_suppkey AS event_id, d.lot_id, d.eqp_id, s_nationkey < 12 AS rooted
  FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey
  JOIN defects d ON d.lot_id = l_orderkey AND d.eqp_id = 'EQ' || l_suppkey
  WHERE l_discount >= 0.09 AND d.step_name = 'R-F' AND d.defect_type = 'label-R'
    AND (s_nationkey >= 12 OR EXISTS (SELECT 1 FROM checked c WHERE c.lot_id = d.lot_id
                                      AND c.key = 'DISC' AND c.state <> 'in_spec'))),
picked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY lot_id) AS n FROM ok)
SELECT event_id, event_id || '-' || n AS case_id, lot_id,
  'R-F,' || eqp_id || ',label-R' || CASE WHEN rooted THEN ',DISC' ELSE '' END AS expected_keywords
FROM picked WHERE n <= 3""",
    "verify_strip_cases": f"""WITH {DIES_SQL}, named AS (
  SELECT DISTINCT label AS lot_id, label % 4 AS e FROM embeddings
  UNION ALL SELECT DISTINCT label, (label + 1) % 4 FROM embeddings),
ok AS (
  SELECT 'SE' || e AS event_id, w.lot_id, w.strip_id, w.pattern,
         row_number() OVER (PARTITION BY e ORDER BY w.lot_id) AS n
  FROM named JOIN worst_strips w USING (lot_id) JOIN region ON r_regionkey = e
  WHERE w.pattern = ['center', 'edge', 'stripe', 'scattered', 'none'][e + 1])
SELECT event_id, event_id || '-' || n AS case_id, lot_id,
  strip_id || ',' || CASE pattern {" ".join(
      f"WHEN '{p}' THEN '{'|'.join(w)}'" for p, w in evals.PATTERN_WORDING.items()
  )} ELSE pattern END AS expected_keywords FROM ok WHERE n <= 3""",
    "keyword_recall": f"""WITH {ANSWERS_SQL}
SELECT case_id, n_keywords, n_hits, misses, label_ok, passed FROM scored""",
    "eval_summary": f"""WITH {ANSWERS_SQL}, long AS (
  SELECT 'overall' AS scope, * FROM scored UNION ALL SELECT event_type, * FROM scored)
SELECT scope, count(*) AS n, count(*) FILTER (passed) AS passed,
  round(count(*) FILTER (label_ok) * 1e0 / count(*), 4) AS label_accuracy,
  round(sum(n_hits) * 1e0 / sum(n_keywords), 4) AS keyword_recall,
  round(count(*) FILTER (passed) * 1e0 / count(*), 4) AS pass_rate,
  round(count(*) FILTER (cited) * 1e0 / count(*), 4) AS citation_rate FROM long GROUP BY scope""",
    "judge_tally": """WITH v AS (
  SELECT lang = 'en' AS strip, quality = 1 AS good, toxic = 0 AS clean
  FROM labels JOIN documents USING (doc_id)),
long AS (
  SELECT 'strip' AS criterion, good AS ok FROM v WHERE strip
  UNION ALL SELECT 'pattern', clean FROM v WHERE strip
  UNION ALL SELECT 'step', good FROM v WHERE NOT strip
  UNION ALL SELECT 'equipment', clean FROM v WHERE NOT strip
  UNION ALL SELECT 'defect', false FROM v WHERE NOT strip
  UNION ALL SELECT 'cause_sound', good AND clean FROM v
  UNION ALL SELECT 'all', strip AND good AND clean FROM v)
SELECT criterion, count(*) AS total, count(*) FILTER (ok) AS ok,
  round(count(*) FILTER (ok) * 1e0 / count(*), 4) AS rate FROM long GROUP BY criterion""",
    "turn_checks": f"WITH {TURNS_SQL} SELECT * FROM checks",
    "file_turn_checks": f"WITH {TURNS_SQL} SELECT * FROM checks",
    "conversation_pass": f"""WITH {TURNS_SQL}, c AS (
  SELECT conv_id, bool_and(passed) AS passed FROM checks GROUP BY conv_id)
SELECT (SELECT count(*) FROM c) AS n_conversations, count(*) AS n_turns,
  round(count(*) FILTER (label_ok) * 1e0 / count(*), 4) AS label_accuracy,
  round(sum(refs_ok) * 1e0 / sum(refs), 4) AS reference_resolution,
  round(count(*) FILTER (passed) * 1e0 / count(*), 4) AS turn_pass_rate,
  (SELECT round(count(*) FILTER (passed) * 1e0 / count(*), 4) FROM c) AS conversation_pass_rate
FROM checks""",
    "error_run_filter": """WITH e AS (
  SELECT user_id AS run_id, event_type IN ('error', 'view') AS bad,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
         - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'view')
                              ORDER BY ts, event_id) AS island FROM events),
islands AS (SELECT run_id, island, count(*) AS len FROM e WHERE bad GROUP BY ALL)
SELECT run_id, count(*) FILTER (NOT bad) AS scored, count(*) FILTER (bad) AS errors,
  coalesce((SELECT max(len) FROM islands i WHERE i.run_id = e.run_id), 0) AS longest_error_run,
  coalesce((SELECT max(len) FROM islands i WHERE i.run_id = e.run_id), 0) >= 3 AS stopped
FROM e GROUP BY run_id""",
    "kpi_totals": f"""WITH {RUNS_SQL}, long AS (
  SELECT intent AS scope, * FROM runs UNION ALL SELECT 'total', * FROM runs)
SELECT scope, count(*) AS queries, sum(fn_calls)::BIGINT AS fn_calls,
  sum(rag_calls)::BIGINT AS rag_calls FROM long GROUP BY scope""",
    "kpi_latency": f"""WITH {RUNS_SQL}, w AS (
  SELECT list(latency_ms ORDER BY latency_ms) AS ms FROM newest WHERE back <= 100)
SELECT len(ms)::INT AS n, round_even(list_sum(ms) * 1e0 / len(ms), 0)::BIGINT AS avg_ms,
  ms[(len(ms) * 95) // 100 + 1] AS p95_ms FROM w""",
    "kpi_stream_latency": f"""WITH {RUNS_SQL}, w AS (
  SELECT list(latency_ms ORDER BY latency_ms) AS ms FROM newest WHERE back <= 100)
SELECT len(ms)::INT AS n, round_even(list_sum(ms) * 1e0 / len(ms), 0)::BIGINT AS avg_ms,
  ms[(len(ms) * 95) // 100 + 1] AS p95_ms FROM w""",
    "kpi_recent": f"""WITH {RUNS_SQL}
SELECT run_id, intent, latency_ms, fn_calls, rag_calls FROM newest WHERE back <= 20""",
    "kpi_stream_recent": f"""WITH {RUNS_SQL}
SELECT run_id, intent, latency_ms, fn_calls, rag_calls FROM newest WHERE back <= 20""",
    "kpi_stream": f"""WITH {RUNS_SQL}
SELECT intent AS scope, count(*) AS queries, sum(fn_calls)::BIGINT AS fn_calls,
  sum(rag_calls)::BIGINT AS rag_calls FROM runs GROUP BY intent""",
    "intent_share": """SELECT event_type AS intent, count(*) AS n,
  round_even(count(*) * 1e2 / (SELECT count(*) FROM events), 0)::BIGINT AS percent
FROM events GROUP BY event_type""",
    "compact_history": f"WITH {history_sql(12)} SELECT conv_id, turn, role, text FROM compact",
    "compact_short_history": f"""WITH {history_sql(SHORT_HISTORY)}
SELECT conv_id, turn, role, text FROM compact""",
    "context_size": f"""WITH {history_sql(SHORT_HISTORY)}
SELECT conv_id, sum(chars)::BIGINT AS chars_before,
  coalesce((SELECT sum(length(text)) FROM compact c WHERE c.conv_id = s.conv_id), 0)::BIGINT
    AS chars_after FROM short s GROUP BY conv_id""",
    "no_data_flag": """SELECT event_id,
  CASE event_type WHEN 'error' THEN '{"error": "not found"}'
    WHEN 'view' THEN '{"message": "nothing recorded"}'
    WHEN 'signup' THEN '{"message": "partial", "recipe": "R1"}' ELSE props END AS result,
  CASE WHEN event_type IN ('error', 'view') THEN 'no_data' ELSE 'ok' END AS status FROM events""",
}
