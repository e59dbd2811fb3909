"""Review of figure captions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RiskPatterns:
    """Tested in the order suspect, flow, structure."""

    suspect: str
    flow: str
    structure: str
    min_chars: int = 50


# Wording of captions that need a look.
KOREAN_CAPTIONS = RiskPatterns(
    suspect="로고|배너|홍보|썸네일|표지|알 수 없|보이지 않|식별.*(어렵|불가)|명확하지 않",
    flow="→|단계|순서|공정 흐름|이어진다",
    structure="단면|적층|층|상단|하단|위에|아래에",
)
REVIEW_ORDER = ("flow", "structure", "suspect", "other")
KNOWN_STATUS = "^(ok|svg|download)"


def risk_class(caption: Column, patterns: RiskPatterns = KOREAN_CAPTIONS) -> Column:
    return (
        F.when(
            (F.length(caption) < patterns.min_chars) | caption.rlike(patterns.suspect), "suspect"
        )
        .when(caption.rlike(patterns.flow), "flow")
        .when(caption.rlike(patterns.structure), "structure")
        .otherwise("other")
    )


def caption_risk_class(
    captions: DataFrame, patterns: RiskPatterns = KOREAN_CAPTIONS
) -> DataFrame:
    """Class of every accepted caption with its place in the review order."""
    accepted = captions.filter((F.col("status") == "ok") & (F.col("caption") != ""))
    category = risk_class(F.col("caption"), patterns)
    priority = F.array_position(F.array(*map(F.lit, REVIEW_ORDER)), F.col("category")).cast("int")
    return accepted.withColumn("category", category).withColumn("priority", priority)


def review_order(classified: DataFrame) -> DataFrame:
    return classified.orderBy("priority", "source", "slug", "section")


def caption_status_summary(
    captions: DataFrame, patterns: RiskPatterns = KOREAN_CAPTIONS
) -> DataFrame:
    """Counts per status, all API failures folded into one, and per class of accepted captions."""
    folded = F.when(F.col("status").rlike(KNOWN_STATUS), F.col("status")).otherwise("api_failed")
    usable = (F.col("status") == "ok") & (F.col("caption") != "")
    labels = F.array_compact(
        F.array(
            F.struct(F.lit("status").alias("kind"), folded.alias("name")),
            F.when(
                usable,
                F.struct(
                    F.lit("class").alias("kind"),
                    risk_class(F.col("caption"), patterns).alias("name"),
                ),
            ),
        )
    )
    return captions.select(F.inline(labels)).groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n")
    )


def apply_exclusions(captions: DataFrame, excluded: DataFrame) -> DataFrame:
    """Accepted captions whose source is listed become ``excluded_manual``."""
    listed = excluded.select("src").distinct().withColumn("listed", F.lit(True))
    status = F.when(
        F.col("listed") & (F.col("status") == "ok"), "excluded_manual"
    ).otherwise(F.col("status"))
    return captions.join(listed, "src", "left").withColumn("status", status).drop("listed")


def exclusion_report(captions: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many captions changed, and how many sources were asked for."""
    changed = (
        captions.filter(F.col("status") == "ok")
        .join(excluded.select("src").distinct(), "src", "left_semi")
        .agg(F.lit("changed").alias("name"), F.count(F.lit(1)).alias("n"))
    )
    requested = excluded.agg(F.lit("requested").alias("name"), F.countDistinct("src").alias("n"))
    return changed.unionByName(requested)
