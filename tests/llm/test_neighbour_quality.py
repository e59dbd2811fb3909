from __future__ import annotations

import numpy as np

from tests.llm.tables import fold, prose, write
from yieldloom.llm import neighbour_quality as nq
from yieldloom.llm import queries


def table(n: int = 400) -> list[tuple]:
    """Ids 130-141 and 111 are labelled bad; here others look like them too."""
    rows = []
    for i in range(n):
        junk = i % 5 == 0
        text = " ".join(f"{w}###" for w in prose(i, 60).split()) if junk else prose(i, 60)
        rows.append((i, text, "s"))
    return rows


def relabel(folder: str, rows) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = [r[0] for r in rows]
    quality = [int(i % 5 != 0) for i in ids]
    pq.write_table(
        pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32())}),
        f"{folder}/labels.parquet",
    )


def test_held_out_accuracy(spark, tmp_path):
    rows = table()
    folder = write(tmp_path / "sf", rows)
    relabel(folder, rows)
    got = queries.op9_neighbour_quality(spark, folder).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and all(r["held_out"] == (fold(r["doc_id"]) == 0) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held]
    assert sum(right) >= 0.97 * len(right)


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(7)
    vectors = nq._normal(rng.standard_normal((50, 8)).astype(np.float32))
    labels = (rng.random(50) < 0.6).astype(float)
    model = nq.Model(np.ones(20, np.float32), rng.standard_normal((20, 8)).astype(np.float32), vectors, labels)
    terms = rng.random((9, 20)).astype(np.float32)
    for row, got in zip(terms, model.scores(terms, 5)):
        latent = row / np.linalg.norm(row) @ model.projection
        cosine = vectors @ latent / np.linalg.norm(latent)
        best = np.argsort(-cosine)[:5]
        votes = np.clip(cosine[best], 0, None)
        assert abs(got - (votes * labels[best]).sum() / votes.sum()) < 1e-5


def test_awkward_rows_get_a_score(spark, folder, records):
    got = queries.op9_neighbour_quality(spark, folder).collect()
    assert len(got) == len(records)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_without_labels_and_without_rows(spark, folder, empty):
    assert queries.op9_neighbour_quality(spark, empty).collect() == []
    docs = queries.documents(spark, folder)
    model = nq.fit(docs, queries.labels(spark, empty))
    assert {r["score"] for r in nq.score(docs, model).collect()} == {1.0}
