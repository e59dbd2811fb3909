from __future__ import annotations

import hashlib
from collections import defaultdict

from tests.llm.tables import ascii_lower, multiset, write
from yieldloom.llm import exact_dedup, queries


def brute(records):
    groups = defaultdict(list)
    for doc_id, text, _ in records:
        groups[hashlib.sha256(ascii_lower(text or "").encode()).hexdigest()].append(doc_id)
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            yield i, keep, len(ids), i == keep, digest


def test_against_brute_force(spark, folder, records):
    got = queries.op5_exact_dedup(spark, folder).collect()
    assert multiset(map(tuple, got)) == multiset(brute(records))


def test_heavy_groups_and_ties_in_the_summary(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}", "s") for i in range(600)]
    docs = queries.documents(spark, write(tmp_path / "sf", rows, clashes=False)).repartition(6)
    # A summary of a few counters can only find the hottest digest; results don't change.
    got = exact_dedup.exact_duplicates(docs, counters=16, winners=4).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows))
    rows_of = exact_dedup.digests(docs, "doc_id", "text")
    found = [r[0] for r in exact_dedup.frequent(rows_of, 16, 4).collect()]
    assert hashlib.sha256(b"hot").hexdigest() in found and len(found) <= 4


def test_empty_table(spark, empty):
    assert queries.op5_exact_dedup(spark, empty).collect() == []
