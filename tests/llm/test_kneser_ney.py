from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.tables import ascii_lower, fold, multiset, words
from yieldloom.llm import kneser_ney as kn
from yieldloom.llm import queries

S, E = "< s >", "< /s >"


def tokens(text):
    return [*words(ascii_lower(text or "")), E]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in range(1, 5)]
    if not (n[0] and n[1]):
        return [0, 0.75, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    two = 2 - 3 * y * n[2] / n[1]
    more = 3 - 4 * y * n[3] / n[2] if n[2] else two
    return [0, 1 - 2 * y * n[1] / n[0], max(0.05, min(2, two)), max(0.05, min(3, more))]


class Brute:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            seq = tokens(t)
            self.words.update(seq)
            self.pairs.update(zip([S, *seq], seq))
        self.left, follow = Counter(), defaultdict(list)
        for (a, b), c in self.pairs.items():
            self.left[b] += 1
            follow[a].append(c)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.left.values())
        self.total = {a: sum(cs) for a, cs in follow.items()}
        self.back = {a: sum(self.d2[min(c, 3)] for c in cs) / sum(cs) for a, cs in follow.items()}
        even = sum(self.d1[min(c, 3)] for c in self.left.values())
        self.even = even / len(self.pairs) / (len(self.words) + 1) if self.pairs else 1.0

    def p(self, a, b):
        one = self.even
        if self.left[b]:
            one += (self.left[b] - self.d1[min(self.left[b], 3)]) / len(self.pairs)
        if a not in self.total:
            return one
        c = self.pairs[a, b]
        return (c - self.d2[min(c, 3)]) / self.total[a] + self.back[a] * one

    def score(self, text):
        seq = tokens(text)
        n, v = sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in seq)
        score = sum(math.log10(self.p(a, b)) for a, b in zip([S, *seq], seq))
        return len(seq), sum(self.words[w] > 0 for w in seq), n, base, score


def test_against_brute_force(spark, folder, records):
    model = Brute([t for i, t, _ in records if fold(i) != 1])
    got = queries.op8_kneser_ney(spark, folder).collect()
    want = [(i, fold(i) == 1, *model.score(t)) for i, t, _ in records]

    def rounded(row):
        return (*row[:5], round(row[5], 6), round(row[6], 6))

    assert multiset(rounded(tuple(r)) for r in got) == multiset(map(rounded, want))


def test_probabilities_add_up_to_one(spark, folder, records):
    model = Brute([t for i, t, _ in records if fold(i) != 1])
    for a in [S, *list(model.total)[:20], "never seen"]:
        known = sum(model.p(a, b) for b in model.words)
        assert known + model.p(a, "never seen either") == pytest.approx(1)


def test_pair_hashes_can_be_undone():
    first, second = np.array([0, 7, 2**32 - 2, 5]), np.array([3, 2**32 - 1, 0, 5])
    codes = kn.pair_codes(first, second)
    assert [x.tolist() for x in kn.pair_words(codes)] == [first.tolist(), second.tolist()]
    many = np.sort(kn.pair_codes(np.arange(5000), np.arange(5000) % 7))
    assert (np.diff(kn.pair_bucket(many, 4)) >= 0).all()
    assert np.bincount(kn.pair_bucket(many, 4) + 8).max() < 3 * 5000 / 16


def test_empty_table_and_nothing_to_learn_from(spark, empty, folder):
    assert queries.op8_kneser_ney(spark, empty).collect() == []
    docs = queries.documents(spark, folder)
    model = kn.train(docs.filter("doc_id < 0"))
    rows = kn.score(docs, model).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in rows)
