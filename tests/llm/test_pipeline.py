from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tests.llm import test_line_runs
from tests.llm.tables import SHARED, multiset, prose, words
from tests.llm.test_shingle_sets import brute_set, similar
from yieldloom.llm import decision_list, mixing, queries
from yieldloom.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(input rows, output rows) of each stage but the last, as dictionaries."""
    docs, out = queries.documents(spark, folder), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, folder), name)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def test_stages_in_order_keep_the_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after and list(after[0]) == list(before[0])


def test_quality_rules_reject_what_the_list_rejects(spark, folder, stages):
    before, after = stages["quality_rules"]
    docs = queries.documents(spark, folder)
    rules = decision_list.fit(docs, queries.labels(spark, folder))
    kept = decision_list.judge(docs, rules).filter("_quality.kept").select("doc_id", "text").collect()
    assert multiset((r["doc_id"], r["text"]) for r in after) == multiset(map(tuple, kept))
    assert {r["doc_id"] for r in after} >= set(range(30)) and 111 not in {r["doc_id"] for r in after}


def test_line_dedup_drops_shared_lines(stages):
    before, after = stages["line_dedup"]
    want = Counter(r[0] for r in test_line_runs.brute([(r["doc_id"], r["text"], None) for r in before]))
    assert Counter(r["doc_id"] for r in after) == want
    holding = [r["doc_id"] for r in after if SHARED.lower() in r["text"].lower()]
    assert holding == [127]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    want = brute_near_dedup([(r["doc_id"], r["text"]) for r in before])
    assert multiset(r["doc_id"] for r in after) == multiset(want)
    assert len(after) < len(before)


def brute_near_dedup(rows):
    """Ids of what stays: groups by flooding over exact similarities of five-word sets."""
    whole, left, out = [brute_set(t) for _, t in rows], set(range(len(rows))), []
    while left:
        group, front = [], [left.pop()]
        while front:
            a = front.pop()
            group.append(rows[a][0])
            near = {b for b in left if whole[a] == whole[b] or similar(whole[a], whole[b])}
            left -= near
            front += near
        out.append(min(group, key=lambda i: (i is None, i or 0)))
    return out


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Ids of several texts, null ids, repeated rows."""
    a, b, c = prose(601, 300), prose(602, 300), prose(603, 300)
    b2 = b.replace("ban", "bar", 1) + " once"
    rows = [(1, a), (2, a), (2, b), (4, b2), (5, c), (5, c), (5, c), (None, c), (None, prose(604, 90))]
    rows += [(None, prose(604, 90)), (6, prose(605, 300)), (6, prose(606, 300)), ((1 << 60) + 1, prose(607, 80))]
    rows += [(7, None), (8, ""), (None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    records = [(i, t, "en", f"s{len(t or '') % 2}", len(t or "")) for i, t in rows]
    return written(spark.createDataFrame(records, kind).repartition(3), "shared-ids")


def test_near_dedup_decides_rows_not_ids(spark, shared_ids):
    before = [(r["doc_id"], r["text"]) for r in shared_ids.collect()]
    after = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, shared_ids, "").collect()]
    assert multiset(r[0] for r in after) == multiset(brute_near_dedup(before))
    assert set(after) <= set(before) and (2, prose(602, 300)) in after
    # A table that comes from no files is taken too, and decided alike.
    loose = spark.createDataFrame(shared_ids.collect(), shared_ids.schema)
    again = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, loose, "").collect()]
    assert multiset(again) == multiset(after)


def test_mix_takes_each_row_as_often_as_it_says(spark, shared_ids):
    plan = mixing.mix(shared_ids).collect()
    after = corpus_pipeline.mix_sources(spark, shared_ids, "").collect()
    want = Counter()
    for r in plan:
        want[r["doc_id"], r["size"]] += r["repeats"]
    got = Counter((r["doc_id"], len(words(r["text"]))) for r in after)
    assert got == +want
    assert {r["doc_id"] for r in plan} == {r["doc_id"] for r in shared_ids.collect()}


def test_stages_leave_the_session_as_it_is(spark, shared_ids):
    before = dict(spark.conf.getAll)
    corpus_pipeline.near_dedup(spark, shared_ids, "").collect()
    queries.packed(shared_ids).collect()
    assert dict(spark.conf.getAll) == before


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mix_sources"]
    texts = {(r["doc_id"], r["text"]) for r in before}
    assert all((r["doc_id"], r["text"]) in texts for r in after)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2 * max(Counter(r["doc_id"] for r in before).values())
    total = sum(len(words(r["text"])) for r in before)
    assert abs(sum(len(words(r["text"])) for r in after) - 1.5 * total) < 0.05 * total


def test_packing_round_trip(stages):
    before, after = stages["pack_sequences"]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        want.update([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    got = Counter()
    for r in after:
        got.update(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    assert got == want


def test_run_and_empty_table(spark, folder, empty, stages):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() == len(stages["pack_sequences"][1])
    assert corpus_pipeline.run(spark, empty).count() == 0
