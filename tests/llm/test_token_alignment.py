from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.tables import multiset
from yieldloom.llm import queries, token_alignment


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        entries = {int(n): base64.b64decode(x) for x, n in map(bytes.split, lines)}
    return a, b, entries


def brute_tokens(tools, text):
    """[(id, bytes), ...] of both, or nothing."""
    if not text:
        return [], []
    a, b, entries = tools
    first = [(i, entries[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        second.append((i, bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (first, second)):
        return [], []
    return first, second


def brute_rows(tools, records):
    """One token after the other, with sets and dictionaries."""
    groups, links, overlaps = [], [], []
    for record in records:
        spans = []
        for side in brute_tokens(tools, record[1]):
            at, rows = 0, []
            for i, piece in side:
                rows.append((i, at, at + len(piece)))
                at += len(piece)
            spans.append(rows)
        a, b = spans
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, start = [], 0
        for end in common:
            sides = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)]
            parts.append("|".join(sides))
            start = end
        groups.append(parts)
        by_end = {e: i for i, _, e in b}
        links.append([(i, by_end[e]) for i, _, e in a if e in by_end])
        bounds = np.array([s for _, s, _ in b] or [0]), np.array([e for _, _, e in b] or [0])
        overlaps.append(sum(int(((bounds[0] < e) & (bounds[1] > s)).sum()) for _, s, e in a))
    counts = Counter(x for pairs in links for x in pairs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for record, parts, pairs, shared in zip(records, groups, links, overlaps):
        a, b = brute_tokens(tools, record[1])
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        n_best = sum(counts[x] == best[x[1]] for x in pairs)
        total = sum(counts[x] for x in pairs)
        out.append((record[0], len(a), len(b), len(parts), len(pairs), n_best, total, digest, shared))
    return out


def test_against_brute_force(spark, folder, records, tools):
    got = queries.op11_token_alignment(spark, folder).collect()
    assert multiset(map(tuple, got)) == multiset(brute_rows(tools, records))


def test_odd_texts(spark, tools):
    texts = [
        "▁ stays apart",
        "a<|endoftext|>b </s> <0x41> <unk>",
        "  two  blanks \t\n\n end ",
        "\U0001f600‍\U0001f9d1 हिन्दी 中文 \x00 �",
        "x" * 5000 + " " * 300 + "\n" * 50,
        "é ﬁ Ａ",
        "a",
    ]
    records = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(records, "doc_id long, text string")
    got = queries.aligned(docs).collect()
    assert multiset(map(tuple, got)) == multiset(brute_rows(tools, records))
    assert [r["n_a"] for r in got if r["doc_id"] == 0] == [0]


def test_text_that_is_not_utf8(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr(
        "doc_id", "cast(X'61FF62' as string) AS text"
    )
    row = queries.aligned(docs).first()
    assert (row["n_a"], row["n_b"], row["groups_sha256"]) == (0, 0, "")


def test_ranges_tell_what_overlaps(spark, tools):
    text = "unbelievable internationalisation, 12345678 cafés"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = token_alignment.align(docs, *queries.both_tokenizers(), ranges=True).first()
    sides = []
    for side in brute_tokens(tools, text):
        ends = np.cumsum([len(x) for _, x in side])
        sides.append(list(zip(ends - [len(x) for _, x in side], ends)))
    short, long = sides if len(sides[0]) <= len(sides[1]) else sides[::-1]
    want = [[i for i, (u, v) in enumerate(long) if u < e and v > s] for s, e in short]
    assert [(r["first"], r["last"]) for r in row["overlaps"]] == [(w[0], w[-1]) for w in want]


def test_gallop_is_a_search():
    rng = np.random.default_rng(5)
    for _ in range(200):
        other = np.unique(rng.integers(0, 300, rng.integers(0, 60)))
        ends = np.unique(rng.integers(-5, 310, rng.integers(0, 60)))
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), len(other))
        start = rng.integers(0, 61, len(ends))
        got = token_alignment.gallop(ends, other, low, high, start)
        assert got.tolist() == np.searchsorted(other, ends).tolist()


def test_empty_table(spark, empty):
    assert queries.op11_token_alignment(spark, empty).collect() == []
