"""Connected components of a graph given by its edges, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the smallest node it is linked to.

    Alternating star rounds: every node hands the smallest node it sees to its larger
    neighbours ("large star"), then to its smaller ones ("small star"), until the edges
    no longer change. What is left is one star per component. Each round is written
    out; the number of rounds grows with the logarithm of the longest chain. The
    smallest neighbour is a pre-aggregated minimum, written before it is joined, so
    that Spark can split the partition of a node with very many neighbours.
    """
    stars = written(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    last = None
    while True:
        # Large star: edges both ways; larger neighbours get the node's minimum.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = _hand_on(both, F.col("b") > F.col("a"))
        # Small star: from the larger end; smaller neighbours and the node itself get it.
        stars = _hand_on(stars, F.lit(True))
        now = stars.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == last:
            break
        last = now
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _hand_on(links: DataFrame, to: F.Column) -> DataFrame:
    """(larger, smaller) edges from each node's neighbours that fulfil ``to`` to its minimum."""
    least = written(
        links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least"
    )
    handed = links.join(least, "a").filter(to)
    new = handed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )
    return written(new.filter(F.col("a") != F.col("b")).distinct(), "stars")
