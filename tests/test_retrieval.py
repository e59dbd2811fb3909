from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldloom.operators import retrieval


def test_exact_terms_longest_first(spark):
    cards = spark.createDataFrame(
        [(1, "die", ["d"]), (2, "Die  Attach", ["attach"]), (3, "attach film", None), (4, "die", []), (5, "x", [])],
        "id long, term string, aliases array<string>",
    )
    queries = spark.createDataFrame(
        [(1, "what is DIE attach"), (2, "a soldier died"), (3, "x d"), (4, "die attach film")], "query_id long, text string"
    )
    index = retrieval.term_index(cards)
    assert "d" not in {r.key for r in index.collect()}
    got = [(r.query_id, r["rank"], r.card_id) for r in retrieval.exact_term_match(index, queries).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 4), (4, 1, 3), (4, 2, 2)]


def test_exact_terms_equal_brute_force_over_long_texts(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ab cde"))
    keys = sorted({"".join(rng.choice(letters, rng.integers(2, 45))).strip() for _ in range(150)})
    # Many keys with one prefix differ in their rarest gram only; one is very long.
    keys += [f"shared prefix of many keys no {i}" for i in range(100)]
    texts = ["".join(rng.choice(letters, n)) for n in (3, 500, 1600, 3000)]
    texts += ["a shared prefix of many keys no 55 and shared prefix of many keys no 7"]
    texts.append(texts[2][:505] + keys[-1] + " " + keys[40] + texts[1])
    keys += [texts[3].strip(), "never met " + texts[3], "".join(rng.choice(letters, 3000)) + "q", "é" * 3, "日本"]
    texts += ["x" + keys[-3] + "y", "ÉÉÉ 日本", "", None]
    cards = spark.createDataFrame([(i, k, []) for i, k in enumerate(keys)], "id long, term string, aliases array<string>")
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    index = retrieval.term_index(cards)
    keyed = {r.key: r.id for r in index.collect()}
    got = {(r.query_id, r.card_id) for r in retrieval.exact_term_match(index, queries, limit=1000).collect()}
    want = {(q, i) for q, t in enumerate(texts) for k, i in keyed.items() if k in " ".join((t or "").split()).lower()}
    assert got == want and want


def test_long_keys_and_many_of_them_are_not_broadcast(spark, monkeypatch):
    keys = [f"{i:04d} " + "long words of a key " * 60 for i in range(30)] + ["of a"]
    cards = spark.createDataFrame([(i, k, []) for i, k in enumerate(keys)], "id long, term string, aliases array<string>")
    queries = spark.createDataFrame([(1, keys[3] + keys[4]), (2, "nothing of all that")], "query_id long, text string")
    index = retrieval.term_index(cards)
    whole = retrieval.exact_term_match(index, queries, limit=10).collect()
    assert {(r.query_id, r.card_id) for r in whole} == {(1, 3), (1, 4), (1, 30), (2, 30)}
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_BYTES", 0)
    assert retrieval.exact_term_match(index, queries, limit=10).collect() == whole
    anchors = {r.key: r.gram for r in retrieval.anchored_keys(index.select("key").distinct(), queries).collect()}
    # Keys that no text can hold are left out; the others have a gram of their own.
    assert set(anchors) == {"of a", *[" ".join(keys[i].split()) for i in (3, 4)]}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8)).astype(float)
    data[7] = data[3]
    rows = [(i, "glossary" if i % 3 else "article", v.tolist()) for i, v in enumerate(data)]
    records = spark.createDataFrame(rows, "id long, kind string, vec array<float>").repartition(5)
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in (0, 3, 50)], "query_id long, vec array<float>")
    return np.float32(data).astype(float), records, queries


def test_vector_topk_is_exact_on_both_paths(vectors):
    data, records, queries = vectors
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    want = set()
    for q in (0, 3, 50):
        distance = np.abs(np.round(1 - unit @ unit[q], 6))
        for kind in ("glossary", "article"):
            ids = sorted((i for i in range(300) if ("glossary" if i % 3 else "article") == kind), key=lambda i: (distance[i], i))
            want |= {(q, kind, i, n + 1) for n, i in enumerate(ids[:4])}
    for options in ({}, {"max_broadcast_values": 0, "rows_per_block": 37}):
        got = {(r.query_id, r.kind, r.id, r.kind_rank) for r in retrieval.vector_topk(records, queries, 4, **options).collect()}
        assert got == want


def test_no_queries_give_no_rows(vectors):
    _, records, queries = vectors
    assert retrieval.vector_topk(records, queries.filter("query_id < 0"), 3).count() == 0


def test_merge_keeps_n_beside_exact_hits(spark):
    exact = spark.createDataFrame([(1, 10, 1)], "query_id long, card_id long, rank int")
    near = spark.createDataFrame(
        [(1, "glossary", 10, 0.1), (1, "glossary", 11, 0.3), (1, "article", 20, 0.2), (1, "article", 21, 0.4), (2, "article", 20, 0.5)],
        "query_id long, kind string, id long, distance double",
    )
    got = [(r.query_id, r.position, r.id) for r in retrieval.merge_by_distance(exact, near, 2).orderBy("query_id", "position").collect()]
    assert got == [(1, 1, 10), (1, 2, 20), (1, 3, 11), (2, 1, 20)]


def test_all_exact_hits_leave_the_nearest_records_alone(spark):
    exact = spark.createDataFrame([(1, 100 + i, i + 1) for i in range(5)], "query_id long, card_id long, rank long")
    near = spark.createDataFrame([(1, "article", i, i / 10) for i in range(4)], "query_id long, kind string, id long, distance double")
    got = [r.id for r in retrieval.merge_by_distance(exact, near, 3).orderBy("position").collect()]
    assert got == [100, 101, 102, 103, 104, 0, 1, 2]


@pytest.mark.parametrize("values", [4_000_000, 0])
def test_null_vectors_are_left_out_and_counted(spark, values):
    records = spark.createDataFrame([(1, "k", [1.0, 0.0]), (2, "k", None), (3, "k", [0.0, 1.0])], "id long, kind string, vec array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, vec array<double>")
    got = retrieval.vector_topk(records, queries, 5, max_broadcast_values=values).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(7, 1), (7, 3)]
    assert retrieval.without_vector(records).first()[0] == 1
    uneven = spark.createDataFrame([(7, [1.0]), (8, [1.0, 2.0])], "query_id long, vec array<double>")
    with pytest.raises(ValueError, match="length"):
        retrieval.vector_topk(records, uneven, 5)


def test_context_text(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, 2, 6), (1, 1, 5)], "query_id long, position int, id long")
    texts = spark.createDataFrame([(5, "A", "a", "u"), (6, "B", "b", None)], "id long, title string, content string, source_url string")
    got = {r.query_id: r.context for r in retrieval.format_context(queries, results, texts).collect()}
    assert got == {1: "[A] (출처: u)\na\n\n---\n\n[B]\nb", 2: retrieval.EMPTY_CONTEXT}


def test_bm25_by_hand(spark):
    texts = ["the cat sat", "the dog the dog", "the cat ran far away", "bird"]
    records = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame([(1, "The cat, the CAT"), (2, "bird"), (3, "unknown")], "query_id long, text string")
    tokens = [t.split() for t in texts]
    mean = sum(map(len, tokens)) / 4
    df = {w: sum(w in t for t in tokens) for t in tokens for w in t}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    assert raw["the"] < 0
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}

    def score(query, doc):
        return sum(
            idf.get(w, 0) * doc.count(w) * 2.5 / (doc.count(w) + 1.5 * (0.25 + 0.75 * len(doc) / mean)) for w in query
        )

    got = {(r.query_id, r.id): r.score for r in retrieval.bm25_topk(records, queries, 10).collect()}
    want = {
        (q, d): round(score(words, tokens[d]), 6)
        for q, words in ((1, "the cat the cat".split()), (2, ["bird"]))
        for d in range(4)
        if score(words, tokens[d]) > 0
    }
    assert got == pytest.approx(want)


def test_fusion_ties_prefer_the_vector_list(spark):
    lists = [(1, "vector", 5, 1), (1, "vector", 6, 2), (1, "bm25", 7, 1), (1, "bm25", 6, 2)]
    frame = spark.createDataFrame(lists, "query_id long, list string, id long, rank int")
    for data in (frame, frame.orderBy(F.desc("list"))):
        got = [r.id for r in retrieval.rrf_fuse(data).orderBy("rank").collect()]
        assert got == [6, 5, 7]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "b", 10), (4, "b", 11)], "query_id long, g string, r int")
    got = {(r.dimension, r.value): r for r in retrieval.retrieval_metrics(ranked, "r", ["g"]).collect()}
    assert (got["overall", ""].accuracy_1, got["overall", ""].n) == (0.25, 4)
    assert got["overall", ""].ndcg_10 == round((1 + 1 / math.log2(11)) / 4, 4)
    assert got["g", "b"].accuracy_5 == 0.0
    for r in got.values():
        assert 0 <= r.accuracy_1 <= r.accuracy_3 <= r.accuracy_5 <= 1


def test_citation_is_containment_of_the_last_part(spark):
    cases = spark.createDataFrame(
        [(1, "[Guide] > mold heat ", ["[Guide] > mold heat > x"]), (2, "y", ["z"]), (3, "y", None)],
        "id long, related_doc string, titles array<string>",
    )
    assert {r.id: r.cited for r in retrieval.doc_cited(cases).collect()} == {1: True, 2: False, 3: False}


def test_index_is_written_by_term(spark, tmp_path):
    records = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, ""), (4, None)], "id long, text string")
    retrieval.build_index(records, str(tmp_path / "idx"), buckets=4)
    back = retrieval.read_postings(spark, str(tmp_path / "idx" / "postings"))
    assert {(r.id, r.term, r.tf, r.dl) for r in back.collect()} == {(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 1, 1)}
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    for _ in range(2):
        found = retrieval.search_index(spark, str(tmp_path / "idx"), queries, 5).collect()
        assert [(r.query_id, r.id, r["rank"]) for r in found] == [(1, 1, 1)]


def test_keyword_index_of_no_records(spark):
    records = spark.createDataFrame([], "id string, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert retrieval.bm25_topk(records, queries, 5).count() == 0


def test_postings_move_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a b a")], "id long, text string").write.parquet(str(tmp_path / "t"))
    plan = retrieval.bm25_postings(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_absorbed_names_lead_to_the_card(spark):
    cards = spark.createDataFrame([(1, "ball grid array", None), (2, "die", ["chip"])], "id long, term string, aliases array<string>")
    absorbed = spark.createDataFrame([(1, "BGA")], "id long, alias string")
    queries = spark.createDataFrame([(7, "what is a bga")], "query_id long, text string")
    got = retrieval.exact_term_match(retrieval.term_index(cards, absorbed), queries).collect()
    assert [(r.card_id, r.key_chars) for r in got] == [(1, 3)]


def test_only_keys_that_a_text_holds_are_moved(spark):
    # All keys share all their grams with all texts; no text holds one, but for the last.
    keys = ["ab cd " * (i // 26 + 2) + chr(97 + i % 26) * 2 for i in range(2000)]
    texts = ["ab cd " * 100 + " ".join(chr(97 + i) for i in range(26)) for _ in range(40)] + [keys[1999] + "."]
    index = retrieval.term_index(spark.createDataFrame([(i, k, []) for i, k in enumerate(keys)], "id long, term string, aliases array<string>"))
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    assert retrieval._held_substrings(index.select("key").distinct(), queries).count() <= 2000
    held = {(q, i) for q, t in enumerate(texts) for i, k in enumerate(keys) if k in t}
    got = {(r.query_id, r.card_id) for r in retrieval.exact_term_match(index, queries, limit=3000).collect()}
    assert got == held and held


def test_scattered_postings_are_moved_once_for_all_queries(spark, tmp_path):
    records = spark.createDataFrame([(i, "a b c a" if i % 2 else "b d") for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(q, "a c d") for q in range(30)], "query_id long, text string")
    retrieval.build_index(records, str(tmp_path / "idx"), buckets=4)
    found = retrieval.search_index(spark, str(tmp_path / "idx"), queries, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # By record, not by record and query.
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\d+L?, query_id", plan)
    assert sorted(found.collect()) == sorted(retrieval.bm25_topk(records, queries, 5).collect())


def test_scores_stay_with_their_record(spark):
    records = spark.createDataFrame([(i, "a b c a" if i % 2 else "b d") for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(q, "a c d") for q in range(30)], "query_id long, text string")
    plan = retrieval.bm25_topk(records, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#", plan) and "hashpartitioning(query_id#" in plan


def test_scores_in_place_equal_those_added_up_by_id(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["alpha", "beta", "gamma", "delta", "eps", "한글", "x_1", "rare"])
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.04, 0.01])) for _ in range(300)]
    texts[10:60] = ["alpha Rare"] * 50
    rows = [(i % 280 if i % 7 else i, t) for i, t in enumerate(texts)] + [(None, "rare"), (None, "rare eps"), (5, None), (900, "")]
    asked = [(q, " ".join(rng.choice(words, 4))) for q in range(20)] + [(1, "rare rare"), (None, "eps"), (40, "unknown"), (41, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for kind in ("long", "string"):
        records = spark.createDataFrame(rows, "id long, text string").withColumn("id", F.col("id").cast(kind)).repartition(3)
        for some in (records, records.groupBy("id").agg(F.max("text").alias("text")).repartition(2)):
            with monkeypatch.context() as small:
                small.setattr(retrieval, "SUMMANDS_PER_BLOCK", 100)
                small.setattr(retrieval, "TOKENS_PER_BLOCK", 50)
                small.setattr(retrieval, "ROWS_PER_BLOCK", 4)
                here = retrieval.bm25_topk(some, queries, 6).collect()
            with monkeypatch.context() as moved:
                moved.setattr(retrieval, "MAX_BROADCAST_ROWS", 0)
                there = retrieval.bm25_topk(some, queries, 6).collect()
            assert sorted(map(str, here)) == sorted(map(str, there)) and len(here) > 100


def test_terms_are_counted_without_sorting_a_text(spark, monkeypatch):
    records = spark.createDataFrame([(1, "b a B"), (2, None), (3, ""), (None, "a 가나 a"), (1, "c")], "id long, text string").coalesce(1)
    monkeypatch.setattr(retrieval, "TOKENS_PER_BLOCK", 3, raising=False)
    rows = retrieval.bm25_postings(records)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "Exchange hash" not in plan
    got = sorted((str(r.id), r.term, r.tf, r.dl) for r in rows.collect())
    assert got == [("1", "a", 1, 3), ("1", "b", 2, 3), ("1", "c", 1, 1), ("None", "a", 2, 3), ("None", "가나", 1, 3)]
