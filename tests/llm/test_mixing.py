from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from tests.llm.tables import multiset, words, write
from yieldloom.llm import mixing, queries


def brute_targets(sizes: dict) -> dict:
    """Reshare the excess round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        rest = want - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.fixture(scope="module")
def mixed(spark, folder):
    return queries.op2_cube_mixing(spark, folder).collect()


def test_sizes_and_targets(mixed, records):
    assert multiset((r["doc_id"], r["size"]) for r in mixed) == multiset((r[0], len(words(r[1]))) for r in records)
    sizes = defaultdict(int)
    for _, text, source in records:
        sizes[source] += len(words(text))
    want = brute_targets(sizes)
    got = {(r["source_size"], round(r["target"], 6)) for r in mixed}
    assert got == {(sizes[s], round(want[s], 6)) for s in sizes}


def test_taken_is_near_the_target(mixed):
    by_target, targets = defaultdict(int), {}
    for r in mixed:
        assert r["taken"] == r["size"] * r["repeats"] and 0 <= r["taken"] <= 2 * r["size"]
        by_target[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    for key, target in targets.items():
        assert abs(by_target[key] - target) <= 0.05 * target + 50


def test_rerun_agrees_on_another_layout(spark, folder, mixed):
    docs = queries.documents(spark, folder).repartition(5)
    again = mixing.mix(docs).select("doc_id", "size", "repeats").collect()
    assert multiset(map(tuple, again)) == multiset((r["doc_id"], r["size"], r["repeats"]) for r in mixed)


def test_many_groups_stay_balanced(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "hot" if i % 3 else "cold") for i, n in enumerate(rng.integers(1, 60, 900))]
    docs = queries.documents(spark, write(tmp_path / "sf", rows, clashes=False))
    got = mixing.mix(docs, group=50).collect()
    for target in {r["target"] for r in got}:
        taken = [r["size"] * r["repeats"] for r in got if r["target"] == target]
        assert abs(sum(taken) - target) <= 2
        # Documents are balanced too: their mean size is that of the source.
        chosen = sum(r["repeats"] for r in got if r["target"] == target)
        n = sum(r["target"] == target for r in got)
        size = next(r["source_size"] for r in got if r["target"] == target)
        assert abs(chosen - n * target / size) <= 6


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 500)
    chances = np.full(500, 0.3)
    out = mixing.fly(sizes, chances, rng.random)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out @ sizes - chances @ sizes) < 1e-4 and abs(out.sum() - 150) < 1e-6


def test_equal_sizes_and_empty_table(spark, empty):
    out = mixing.fly(np.full(7, 4), np.full(7, 0.5), np.random.default_rng(0).random)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert queries.op2_cube_mixing(spark, empty).collect() == []


def test_ids_come_back_as_they_are(spark, tmp_path):
    big = 1 << 60
    rows = [(big + k, "w " * (5 + k), "s") for k in (1, 3, 5, 7, 9)] + [(None, "w w w", "s")]
    docs = queries.documents(spark, write(tmp_path / "sf", rows, clashes=False))
    got = mixing.mix(docs, carry=["n_chars"]).collect()
    assert multiset(r["doc_id"] for r in got) == multiset(r[0] for r in rows)
    assert all(r["n_chars"] == 2 * r["size"] or r["doc_id"] is None for r in got)
