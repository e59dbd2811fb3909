"""SimHash fingerprints, linked by blocks that close pairs must share.

Two 64-bit fingerprints that differ in at most three bits agree in at least three of
six blocks, so they meet under one of the 20 choices of three blocks. Fingerprints,
not documents, are linked: copies have one fingerprint, and near copies few.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import groups_of, raw_texts, written
from yieldloom.llm.components import components

BITS, DISTANCE = 64, 3
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Buckets up to this size are joined in Spark; their pairs are few.
JOINED = 64
#: Buckets up to this size are linked in one task, and only a spanning forest leaves it.
LINKED = 4096
TEXT_BYTES = 8 << 20


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    sums = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return sums


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([digest(line, seed)], np.uint64)
    else:
        ends = list(itertools.accumulate([len(w) + 1 for w in words]))
        starts = [0, *ends]
        hashes = np.fromiter(
            (digest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])),
            np.uint64,
            len(words) - shingle + 1,
        )
    bits = 2 * _bit_sums(hashes) > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) of every document; null texts have no words."""
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, TEXT_BYTES):
            fps = pa.array([fingerprint(t, shingle) for t in raw_texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"id {ids}, fp long")


def masks() -> list[int]:
    """One mask per choice of three blocks, as signed 64-bit numbers."""
    places = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    blocks = [((1 << w) - 1) << p for w, p in zip(WIDTHS, places)]
    return [_signed(sum(c)) for c in itertools.combinations(blocks, len(WIDTHS) - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _finer(mask: int) -> list[int]:
    """Masks that also fix one of four parts of the bits still free in ``mask``.

    Of four parts, three differing bits leave one untouched, so a close pair of the
    bucket meets again under at least one finer mask.
    """
    free = [i for i in range(BITS) if not (mask >> i) & 1]
    return [
        _signed((mask & ((1 << BITS) - 1)) | sum(1 << i for i in part))
        for part in (free[k :: DISTANCE + 1] for k in range(DISTANCE + 1))
    ]


def close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``: at most one edge per fingerprint.

    Breadth first: the reached fingerprints take all unreached ones close to them.
    """
    left, edges = np.unique(fps), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            gap = np.bitwise_count((left ^ front[0]).view(np.uint64)) <= DISTANCE
            found = left[gap]
            edges += [(int(front[0]), int(x)) for x in found]
            front, left = np.concatenate([front[1:], found]), left[~gap]
    return edges


def _bucket_edges(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(spanning(group["fp"].to_numpy(np.int64)), columns=["a", "b"], dtype="int64")


def _buckets(keyed: DataFrame, name: str) -> DataFrame:
    """Rows (fp, mask, key) in buckets of two or more, with the bucket's size ``n``."""
    sizes = written(
        keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1),
        f"{name}-sizes",
    )
    return written(keyed.join(sizes, ["mask", "key"]), name)


def links(nodes: DataFrame, joined: int = JOINED, linked: int = LINKED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at ``DISTANCE`` bits or less.

    ``nodes`` holds different fingerprints ``fp``. Small buckets are joined with
    themselves; larger ones give a spanning forest; buckets beyond ``linked`` are
    split by further bits first, so no task gets an unbounded group, and no pair is
    left out. After at most a few rounds too few bits are free for a larger bucket.
    """
    choice = F.explode(F.array(*[F.lit(m).cast("long") for m in masks()])).alias("mask")
    keyed = nodes.select("fp", choice).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    edges = None
    while True:
        rows = _buckets(keyed, "buckets")
        few = rows.filter(F.col("n") <= joined).select("mask", "key", "fp")
        other = few.withColumnRenamed("fp", "fp2")
        pairs = few.join(other.hint("merge"), ["mask", "key"]).filter(
            (F.col("fp") < F.col("fp2")) & close(F.col("fp"), F.col("fp2"))
        )
        some = rows.filter((F.col("n") > joined) & (F.col("n") <= linked))
        trees = some.groupBy("mask", "key").applyInPandas(_bucket_edges, "a long, b long")
        found = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).unionByName(trees)
        edges = found if edges is None else edges.unionByName(found)
        many = rows.filter(F.col("n") > linked)
        present = [r[0] for r in many.select("mask").distinct().collect()]
        if not present:
            return edges
        split = F.create_map(
            *[x for m in present for x in (F.lit(m).cast("long"), F.array(*map(F.lit, _finer(m))))]
        )
        keyed = (
            many.select("fp", F.explode(split[F.col("mask")]).alias("mask"))
            .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
            .distinct()
        )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links between fingerprints that
    differ in three bits or less. Null and empty texts have fingerprint zero, and
    texts with fewer words than a shingle hash them all as one. Repeated rows are
    copies of each other. A null id is never a component's name unless all its ids
    are null. An empty table gives no rows; other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    # A root is a fingerprint; its component is named after the smallest id in it.
    roots = written(components(links(nodes.select("fp"))), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("component")), "components")
    by_fp = written(named.join(least, "root").select("fp", "component"), "by-fingerprint")
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
