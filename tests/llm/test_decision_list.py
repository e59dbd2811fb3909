from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd

from tests.llm.tables import BLANKS, multiset, words
from yieldloom.llm import decision_list as dl
from yieldloom.llm import queries


def brute(text: str | None) -> tuple:
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(ch in "#*$%&|<>" for ch in text or "")
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


def test_statistics_and_verdicts(spark, folder, records):
    got = queries.op3_decision_list(spark, folder).collect()
    assert multiset(tuple(r)[:7] for r in got) == multiset((r[0], *brute(r[1])) for r in records)
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
        if r["doc_id"] is not None and 130 <= r["doc_id"] < 142:
            assert not r["kept"]
        if r["doc_id"] is not None and r["doc_id"] < 30:
            assert r["kept"] == (not r["base_failed"])


def test_repeated_windows_overlap():
    for text in ("a " * 9, "a b c d e f a b c d e", "a b c d e x a b c d e y a b c d", "a b c d"):
        assert dl.repeated_words(text.encode().split()) == brute(text)[4]


def stats(n: int, rng) -> pd.DataFrame:
    table = pd.DataFrame(rng.integers(0, 50, (n, len(dl.STATISTICS))), columns=dl.STATISTICS)
    return table.assign(n_words=100, n_lines=10, word_chars=500)


def test_learns_a_conjunction_in_order(spark):
    rng = np.random.default_rng(5)
    table = stats(2000, rng)
    bad = ((table["n_symbols"] > 30) & (table["n_digits"] > 25)).to_numpy()
    rules = dl.learn(table, bad, rng.random(2000) < 0.33)
    assert rules
    hit = np.zeros(len(table), bool)
    for rule in rules:
        hit |= dl.covers(rule, dl.features_of(table))
    assert (hit == bad).mean() > 0.98
    # Spark's conditions agree with the ones learned from.
    frame = spark.createDataFrame(table.assign(row=np.arange(len(table))))
    from pyspark.sql import functions as F

    at = F.struct(*dl.STATISTICS)
    got = {r[0] for r in frame.filter(dl.chain(rules, at).isNotNull()).select("row").collect()}
    assert got == set(np.flatnonzero(hit).tolist())


def test_noise_gives_no_rules():
    rng = np.random.default_rng(6)
    assert dl.learn(stats(600, rng), rng.random(600) < 0.1, rng.random(600) < 0.33) == []


def test_empty_table(spark, empty):
    assert queries.op3_decision_list(spark, empty).collect() == []


def test_only_chosen_texts_are_counted(spark, folder):
    """The counting step stands above the join with the sample, not below it."""
    docs, labels = queries.documents(spark, folder), queries.labels(spark, folder)
    rows = dl.chosen_statistics(docs, labels, "doc_id", "text", "quality", 7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("ArrowEvalPython") < plan.index("BroadcastHashJoin")
    assert plan.count("ArrowEvalPython") == 1
    assert rows.count() <= 7
