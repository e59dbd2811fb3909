from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tests.llm.tables import ascii_lower, multiset, words
from yieldloom.llm import components, queries, simhash


def brute_fingerprint(text: str | None) -> int:
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points: list[int]) -> list[int]:
    """Smallest position reachable over links of at most three bits, by flooding."""
    root = list(range(len(points)))
    for i in range(len(points)):
        if root[i] == i:
            front = [i]
            while front:
                a = front.pop()
                for b in range(len(points)):
                    if root[b] > i and (points[a] ^ points[b]).bit_count() <= 3:
                        root[b] = i
                        front.append(b)
    return root


def test_against_brute_force(spark, folder, records):
    got = queries.op6_simhash(spark, folder).collect()
    fps = [brute_fingerprint(r[1]) for r in records]
    roots = brute_components(fps)
    ids = {}
    for r, root in zip(records, roots):
        ids.setdefault(root, []).append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    want = [(r[0], f"{fp:016x}", least[root]) for r, fp, root in zip(records, fps, roots)]
    assert multiset(map(tuple, got)) == multiset(want)
    assert {r["component_id"] for r in got if r["doc_id"] in (104, 105, 106, 107)} == {104}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("joined", "linked"), [(64, 4096), (2, 8), (2, 40)])
def test_links_on_every_path(spark, joined, linked):
    """Clusters whose buckets are joined, linked in a task, or split first."""
    rng = random.Random(8)
    points = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(3):
        walk = rng.getrandbits(64)
        for _ in range(60):
            walk ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            points.append(walk)
    centre = rng.getrandbits(64)
    points += [centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))) for _ in range(200)]
    points = sorted(set(points))
    nodes = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    edges = simhash.links(nodes, joined, linked)
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    roots = brute_components(points)
    groups = {}
    for p, root in zip(points, roots):
        groups.setdefault(root, set()).add(signed(p))
    got = {}
    for p in map(signed, points):
        got.setdefault(found.get(p, p), set()).add(p)
    assert multiset(map(sorted, got.values())) == multiset(map(sorted, groups.values()))


def test_spanning_forest_is_small():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 10, 700).astype(np.int64)
    edges = simhash.spanning(fps)
    assert len(edges) < len(np.unique(fps))


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000)}


def test_empty_table(spark, empty):
    assert queries.op6_simhash(spark, empty).collect() == []
