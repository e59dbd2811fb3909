from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.tables import multiset
from yieldloom.llm import packing, queries


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces(spark, folder):
    return queries.packed(queries.documents(spark, folder)).collect()


def test_every_id_lies_in_one_piece(pieces, records, exact):
    by_doc = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
    for doc_id in {r[0] for r in records}:
        texts = [r[1] for r in records if r[0] == doc_id]
        whole = [[*exact(t), 1] for t in texts]
        # Rows that share an id: their pieces together are all their ids.
        got = multiset((s, i, ids[j]) for s, ids, _ in by_doc[doc_id] for j, i in enumerate(range(s, s + len(ids))))
        want = multiset((s, i, w[i]) for w in whole for s, i in _starts(w, by_doc[doc_id]))
        if len(texts) == 1:
            assert b"".join(np.array(p[1], "<u4").tobytes() for p in sorted(by_doc[doc_id])) == np.array(whole[0], "<u4").tobytes()
            assert {p[2] for p in by_doc[doc_id]} == {len(whole[0])}
        assert len(got) == sum(map(len, whole)), (doc_id, len(want))


def _starts(whole, parts):
    return [(s, i) for s, ids, _ in parts for i in range(s, min(s + len(ids), len(whole)))]


def test_sequences_are_gapless_and_full(pieces):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    total = padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total + 2048


def test_ids_equal_the_tokenizers_library(exact):
    encode = packing.token_ids(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    rng = random.Random(3)
    stock = [*"aZ09 \n\t'.!é漢🙂‍́ſ", "  ", "\r\n", "'s", "<|endoftext|>", "the", " ", "\x00"]
    for _ in range(400):
        text = "".join(rng.choices(stock, k=rng.randint(0, 60)))
        assert encode(text) == exact(text), repr(text)


@pytest.mark.parametrize("length", [1, 16, 25, 500, 683, 1000, 1023, 1024, 1025, 1500, 2047])
def test_cuts_fill_their_bins(length):
    parts = packing.cuts(length, 2048, packing.SLACK, packing.TAIL)
    assert sum(parts) == length and all(p > 0 for p in parts)
    assert all(p <= packing.TAIL or (2048 // p) * p >= (1 - packing.SLACK) * 2048 - 2048 // p for p in parts)


def test_rerun_agrees(spark, folder, pieces):
    again = queries.packed(queries.documents(spark, folder)).collect()
    assert multiset(map(tuple, again)) == multiset(map(tuple, pieces))


def test_empty_table(spark, empty):
    assert queries.op1_harmonic_packing(spark, empty).collect() == []
