"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are hashed trigrams of its bytes, trigrams of its letters' shapes
(capital, small, digit, mark) and how its words and lines repeat. Latent-semantic
analysis of a bounded labelled sample gives a projection; the sample's vectors are
broadcast, and every document's cosine with each of them is computed in blocks. The
most similar neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import groups_of, raw_texts

#: Labelled documents that are fitted and broadcast, at most: SAMPLE x RANK floats.
SAMPLE, RANK = 3_000, 64
#: Hashed terms of each sort, and how much a shape counts against a trigram.
TRIGRAMS, SHAPES, SHAPE_WEIGHT, REPEAT_WEIGHT = 2048, 1024, 2.0, 6.0
TERMS = TRIGRAMS + SHAPES + 3
NEIGHBOURS, THRESHOLD = 15, 0.3
BLOCK = 256
TEXT_BYTES = 4 << 20

_SHAPE = bytes(
    65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b > 127
    else 32 if b == 32 or 9 <= b <= 13 else b
    for b in range(256)
)


def _trigrams(raw: bytes, size: int) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(size, np.float32)
    mixed = (codes[:-2] * 65_599 + codes[1:-1]) * 65_599 + codes[2:]
    mixed = (mixed * np.uint32(2_654_435_761)) >> np.uint32(16)
    return np.bincount(mixed % size, minlength=size).astype(np.float32)


def term_vector(text: bytes) -> np.ndarray:
    """Log-scaled term counts of a whole text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    fresh = 1 - len(set(words)) / n
    dup = 1 - len(set(lines)) / max(1, len(lines))
    return np.concatenate(
        [
            np.log1p(_trigrams(text.lower(), TRIGRAMS)),
            SHAPE_WEIGHT * np.log1p(_trigrams(text.translate(_SHAPE), SHAPES)),
            REPEAT_WEIGHT * np.array([10 * same, 2 * fresh, dup], np.float32),
        ]
    ).astype(np.float32)


def _normal(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return _normal(_normal(terms * self.weights) @ self.projection)

    def scores(self, terms: np.ndarray, neighbours: int) -> np.ndarray:
        """Share of label 1 in the votes of the nearest labelled documents, 0 to 1."""
        prior = float(self.labels.mean()) if len(self.labels) else 1.0
        if not len(self.labels):
            return np.full(len(terms), prior)
        near = self.latent(terms) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(near, best, axis=1), 0, None).astype(np.float64)
        total = votes.sum(axis=1)
        share = (votes * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, prior), 0.0, 1.0)


def latent_space(terms: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(term weights, projection) by a truncated, randomised singular value decomposition."""
    present = (terms > 0).sum(axis=0)
    weights = (np.log((1 + len(terms)) / (1 + present)) + 0.2).astype(np.float32)
    rows = _normal(terms * weights)
    rng = np.random.default_rng(11)
    k = min(rank, *rows.shape)
    basis = rng.standard_normal((rows.shape[1], min(k + 16, rows.shape[1]))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return weights, (basis @ right[:k].T).astype(np.float32)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    rank: int = RANK,
) -> Model:
    """Model from at most ``sample`` labelled documents: half of each label if there are enough.

    The sample takes ids in the order of a hash. An id with several labels has the
    smallest; null ids and labels are left out. The driver gets the sample's term
    counts, ``sample`` x TERMS numbers, whatever the table.
    """
    one = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_label"))
    )
    half = sample // 2
    order = [F.xxhash64("_id"), F.col("_id")]
    bad = one.filter(F.col("_label") == 0).orderBy(*order).limit(half)
    good = one.filter(F.col("_label") != 0).orderBy(*order).limit(half)
    # At most ``sample`` pairs of numbers.
    chosen = F.broadcast(bad.unionByName(good))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(chosen, "_id")
        .select("_id", "_label", "_text")
        .dropDuplicates(["_id"])
        .mapInArrow(_sparse_terms, "id string, label int, places array<int>, values array<float>")
        .toArrow()
    )
    terms = np.zeros((rows.num_rows, TERMS), np.float32)
    labelled = sorted(
        zip(*(rows.column(c).to_pylist() for c in ("id", "label", "places", "values"))),
        key=lambda r: r[0],
    )
    for at, (_, _, places, values) in zip(terms, labelled):
        at[places] = values
    votes = np.array([float(r[1] != 0) for r in labelled])
    if not len(labelled):
        empty = np.zeros((0, 1), np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), empty, votes)
    weights, projection = latent_space(terms, rank)
    vectors = _normal(_normal(terms * weights) @ projection)
    return Model(weights, projection, vectors.astype(np.float32), votes)


def _sparse_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups_of(batches, TEXT_BYTES):
        vectors = [term_vector(t) for t in raw_texts(batch.column(2))]
        places = [np.flatnonzero(v).astype(np.int32) for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.string()),
                batch.column(1),
                pa.array(places, pa.list_(pa.int32())),
                pa.array([v[p] for v, p in zip(vectors, places)], pa.list_(pa.float32())),
            ],
            ["id", "label", "places", "values"],
        )


def score(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """(id, score) of every document from its text alone.

    Null and empty texts get the votes of their empty term vector, which are the
    labels' mean. Repeated rows get equal scores; an empty table gives no rows; other
    columns are not read. A worker holds the model and one block of documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, TEXT_BYTES):
            texts = raw_texts(batch.column(1))
            out = []
            for start in range(0, len(texts), BLOCK):
                terms = np.stack([term_vector(t) for t in texts[start : start + BLOCK]])
                out.append(shared.value.scores(terms, neighbours))
            scores = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    return (
        docs.select(id_col, text_col)
        .mapInArrow(run, f"id {kind}, score double")
        .withColumnRenamed("id", id_col)
    )
