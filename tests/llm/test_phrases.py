from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.tables import ascii_lower, multiset, prose
from yieldloom.llm import phrases, queries
from yieldloom.llm.quotient_filter import Filter, added, merge, permute, restore


def brute(records, min_count=100, max_words=5, top=2000):
    """(lang, text) rows, all phrases in one dictionary."""
    f, n = Counter(), Counter()
    for lang, text in records:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {x: a for x, a in f.items() if a >= min_count}
    out = {}
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        covered = any(
            o == lang and len(v) > len(w) and b >= a
            and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (o, v), b in often.items()
        )
        if not covered:
            cuts = [
                (1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))
            ]
            score, k = min(cuts)
            row = (" ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)
            out.setdefault(lang, []).append(row)
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows += [(lang, i, *r) for i, r in enumerate(found[:top], 1)]
    return rows


@pytest.fixture(scope="module")
def texts():
    out = [(f"l{i % 3}" if i % 4 else None, prose(i, 300)) for i in range(60)]
    out += [("und", prose(3, 400)), ("l1", None), ("l1", ""), (None, " \t. ,\n"), ("", prose(2, 500))]
    out += [("l0", "a b c d e f, a b c d e f " * 40), ("l0", "x x x x x x x " * 60), ("a b", "É é İ " * 30)]
    out += [("l2", "The Cat. sat\x0bon\tthe  cat! the\x0ccat\x00 " * 50)] * 2
    out += [("l1", prose(77, 20_000))]
    return out


@pytest.mark.parametrize(("min_count", "top"), [(5, None), (20, 30), (100, 2000)])
def test_against_brute_force(spark, texts, min_count, top):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    got = phrases.collocations(docs, min_count=min_count, top=top).collect()
    assert multiset(map(tuple, got)) == multiset(brute(texts, min_count, top=top))
    assert got


def test_with_small_pieces_and_filters(spark, texts):
    """Many flushes, ranges and merges give the same."""
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(6)
    small = phrases.Limits(1 << 12, 200, 1 << 9, 100, 3)
    got = phrases.collocations(docs, min_count=4, max_words=4, top=None, limits=small).collect()
    assert multiset(map(tuple, got)) == multiset(brute(texts, 4, 4, None))


def test_bytes_that_are_no_text(spark):
    docs = spark.range(30).selectExpr("'x' AS lang", "cast(X'6120FF62206320' as string) AS text")
    got = phrases.collocations(docs, min_count=30).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [("a �b c", 30, 90)]


def test_exact_beyond_64_bits(spark):
    big = 3_037_000_500 * 1000
    rows = spark.createDataFrame(
        [(big, [big + 1], [big + 7], 5 * big)], "a long, l array<long>, r array<long>, n long"
    )
    got = rows.select(phrases._score(rows["n"]).alias("x")).first()["x"]["score"]
    assert got == 1000 * big * 5 * big // ((big + 1) * (big + 7))


def test_without_frequent_phrases(spark, folder, empty):
    assert queries.op13_phrase_collocations(spark, empty).collect() == []
    docs = spark.createDataFrame([("x", "one two")], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    queries.op13_phrase_collocations(spark, folder).collect()


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 8, 16, 17, 31, 33, 48, 63, 64])
def test_permutation_and_filter_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    space = 1 << bits
    keys = np.unique(rng.integers(0, space, 3000, dtype=np.uint64, endpoint=False) if bits < 64
                     else rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    codes = permute(keys, bits)
    assert len(np.unique(codes)) == len(keys) and (restore(codes, bits) == keys).all()
    counts = rng.integers(1, 600, len(keys))
    parts = []
    for _ in range(3):
        pick = np.flatnonzero(rng.random(len(keys)) < 0.7)
        if len(pick):
            parts.append((codes[pick], counts[pick]))
    blocks = [Filter.of(*added(c, n), bits).pack() for c, n in parts]
    whole = merge([Filter.unpack(b) for b in blocks])
    want = Counter()
    for c, n in parts:
        want.update(dict(zip(c.tolist(), n.tolist())))
    assert dict(zip(whole.codes().tolist(), whole.counts.tolist())) == want
    places = np.arange(len(whole.rests))
    assert (whole.find(whole.codes()) == places).all() and (whole.at(places) == whole.codes()).all()
    missing = np.setdiff1d(rng.integers(0, min(space, 1 << 62), 500, dtype=np.uint64), whole.codes())
    assert (whole.find(missing) == -1).all()
