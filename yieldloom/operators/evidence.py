"""Search terms derived from analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of the knowledge cards for each strip pattern.
PATTERN_TERMS = {
    "center": ["emap 패턴", "중앙 집중", "중앙 집중형", "Center Cluster"],
    "edge": ["emap 패턴", "가장자리 분포", "에지 집중형", "Edge Concentration"],
    "stripe": [
        "emap 패턴",
        "라인·스트라이프 분포",
        "라인/스트라이프형",
        "Line Stripe",
        "멀티헤드",
    ],
    "scattered": ["emap 패턴", "산발 분포", "랜덤 산발형", "Random Distribution"],
    "none": ["emap 패턴", "불량 없음"],
}


def evidence_terms(
    violations: DataFrame, defects: DataFrame, worst_strips: DataFrame
) -> DataFrame:
    """Ordered, de-duplicated search terms per lot.

    Order: violated items with their direction, worst step, defect label, words
    for the strip pattern. Entries are made distinct before they are shuffled, once and
    by lot, so what arrives for a lot is bounded by its recipe however many violations
    it has.
    """

    def entry(block: int, terms: F.Column, sub: F.Column | None = None) -> F.Column:
        """Terms of one place; entries sort by block, then by ``sub``."""
        sub = F.lit("") if sub is None else sub
        return F.struct(F.lit(block).alias("block"), sub.alias("sub"), terms.alias("terms"))

    from_specs = violations.select(
        "lot_id", entry(1, F.array("key", "state"), F.concat_ws("/", "key", "state")).alias("entry")
    )
    from_steps = defects.select(
        "lot_id",
        F.explode(
            F.array(entry(3, F.array("step_name")), entry(4, F.array("defect_type")))
        ).alias("entry"),
    )
    words = F.create_map(
        *[
            item
            for pattern, terms in PATTERN_TERMS.items()
            for item in (F.lit(pattern), F.array(*map(F.lit, terms)))
        ]
    )
    from_strips = worst_strips.select(
        F.col("lot_id").cast("long").alias("lot_id"),
        entry(5, F.element_at(words, F.col("pattern"))).alias("entry"),
    ).filter(F.col("entry.terms").isNotNull())
    entries = from_specs.unionByName(from_steps).unionByName(from_strips)
    placed = F.array_sort(F.collect_set("entry"))
    terms = F.transform(F.flatten(F.transform(placed, lambda x: x["terms"])), F.trim)
    return (
        entries.groupBy("lot_id")
        .agg(F.array_join(F.array_distinct(F.filter(terms, lambda t: t != "")), " ").alias("terms"))
        .filter(F.col("terms") != "")
    )
