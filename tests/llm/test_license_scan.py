from __future__ import annotations

import random
import re

import pytest

from tests.llm.tables import ascii_lower, multiset, prose
from yieldloom.llm import license_scan, queries

NOTICE = {label: license_scan._words(text) for label, text in license_scan.NOTICES}
EDITS = random.Random(3)


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute(doc_id, text):
    """Every start and every template, compared word by word."""
    w = brute_words(text)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    best = []
    for label, words in NOTICE.items():
        grams = len(words) - 3
        hits = {}
        for t in range(grams):
            for i in range(len(w) - 3):
                if w[i : i + 4] == words[t : t + 4]:
                    hits.setdefault(i - t, set()).add(t)
        shares = [
            (len(set().union(*(s for e, s in hits.items() if d <= e <= d + 8))) / grams, -d) for d in hits
        ]
        if shares:
            share, d = max(shares)
            best.append((label, -d, -d + grams + 3, share))
    standing = {
        x[0]
        for x in best
        if x[3] >= 0.8
        and not any(
            o[1] < x[2] and x[1] < o[2] and (o[3] > x[3] or (o[3] == x[3] and o[0] < x[0])) for o in best
        )
    }
    score = 1.0 if starts else max([x[3] for x in best], default=0.0)
    return (
        doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | standing)), score,
    )


def changed(words, n):
    """Some words put in, left out or replaced, one after the other."""
    words = list(words)
    for _ in range(n):
        at = EDITS.randrange(len(words))
        words[at : at + EDITS.randrange(2)] = ["word"] * EDITS.randrange(2)
    return words


@pytest.fixture(scope="module")
def texts(records):
    out = [(r[0], r[1]) for r in records]
    for n, (label, text) in enumerate(license_scan.NOTICES):
        out.append((200 + n, text))
        out.append((230 + n, f"{prose(n, 50)}\n// {text.upper()}\n{prose(n + 9, 50)} " * 2))
        for k in (1, 2, 4, 8):
            out.append((1000 * k + n, " ".join(["é", *changed(NOTICE[label], k), "end"])))
    out += [
        (300, "MIT License, the mit-license; Apache  License CC BY-NC gnu general public license"),
        (301, "gnu general public license gnu general public gnu general public license"),
        (302, "mit"),
        (303, "mit licenses cc  bye the mit"),
        (303, "mit license"),
        (303, "mit license"),
        (None, "MIT\x00license"),
        (None, "cc by"),
        (304, license_scan.NOTICES[6][1] + license_scan.NOTICES[0][1]),
        (305, "mit license " * 3000 + prose(1, 20_000) + " apache license"),
    ]
    return out


def test_against_brute_force(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in license_scan.scan_licenses(docs).drop("notices").collect()]
    assert multiset(got) == multiset(brute(*r) for r in texts)
    labels = {r[0]: r[6] for r in got}
    assert [labels[200 + n] for n in range(len(NOTICE))] == [
        {"apache": "apache", "gpl": "gpl"}.get(label, label) for label in NOTICE
    ]


def test_places_of_notices(spark):
    text = f"{prose(4, 30)} {license_scan.NOTICES[7][1]}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = license_scan.scan_licenses(docs).first()
    assert [tuple(x) for x in row["notices"]] == [("isc", len(brute_words(prose(4, 30))), 1.0)]


def test_plan_is_native_and_broadcasts_only_templates(spark, folder):
    frame = queries.op12_license_scan(spark, folder)
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_with_clashing_columns_and_no_rows(spark, folder, empty, records):
    got = queries.op12_license_scan(spark, folder).collect()
    assert multiset(map(tuple, got)) == multiset(brute(r[0], r[1]) for r in records)
    assert queries.op12_license_scan(spark, empty).collect() == []
