"""Clean and structured documents: sections, captions, metadata, quality gate.

A document is one row and its sections and captions are arrays of that row, so
nothing here shuffles except the join with the exclusion list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import text as X

CAPTION_PREFIX = "[그림 설명: "


def normalize_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", X.normalize_text(F.col("text")))


def block_dedupe(blocks: DataFrame) -> DataFrame:
    """First of identical block texts inside each page, with all its columns; pre-aggregated."""
    others = [c for c in blocks.columns if c not in ("page_id", "text")]
    first = F.min_by(F.struct(*others), F.struct("pos", *[c for c in others if c != "pos"]))
    return (
        blocks.groupBy("page_id", "text")
        .agg(first.alias("first"))
        .select("page_id", "text", "first.*")
        .select(blocks.columns)
    )


def quality_gate(docs: DataFrame) -> DataFrame:
    """Which documents enter the corpus, and why not."""
    chars = F.length("body")
    count = X.section_count(F.col("body"))
    short = (F.col("doc_type") == "article") & (chars < schemas.MIN_ARTICLE_CHARS)
    empty_glossary = (F.col("doc_type") == "glossary") & (count == 0)
    reason = (
        F.when(short, "too_short")
        .when(empty_glossary, "no_terms")
        .when((F.col("doc_type") == "article") & (count == 0), "no_sections")
    )
    return docs.select(
        "doc_id",
        "source",
        chars.alias("chars"),
        count.alias("sections"),
        (~(short | empty_glossary)).alias("include"),
        reason.alias("reason"),
    )


def split_sections(docs: DataFrame) -> DataFrame:
    """One row per section."""
    return docs.select("doc_id", F.inline_outer(X.sections(F.col("body")))).filter(
        F.col("ordinal").isNotNull()
    )


def md_header_sections(docs: DataFrame) -> DataFrame:
    """Headed sections only, without the preamble and without bold markers."""
    headed = F.filter(X.sections(F.col("body")), lambda s: s["heading"].isNotNull())
    return docs.select("doc_id", F.inline_outer(headed)).filter(F.col("ordinal").isNotNull()).select(
        "doc_id",
        "ordinal",
        F.col("heading").alias("title"),
        F.replace("text", F.lit("**"), F.lit("")).alias("text"),
    )


def parse_series(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "title", X.series_and_part(F.col("title")).alias("s")).select(
        "doc_id", "title", "s.*"
    )


def accepted(captions: Column) -> Column:
    return F.filter(captions, lambda c: (c["status"] == "ok") & (c["caption"] != ""))


def merge_captions(docs: DataFrame) -> DataFrame:
    """Documents with ``sections`` and ``captions`` arrays -> sections with captions in place.

    An accepted caption is appended to the last section at or before its heading number,
    or to the first. Linear in sections and captions: a table leads from heading numbers
    to sections, and the captions sorted by section fall into runs. Each step names the
    column of the one before more than once, which keeps Spark from computing it anew
    for every element.
    """
    none = F.array().cast("array<struct<section:int,caption:string,status:string>>")
    slots, usable, placed, starts, tails = map(
        F.col, ("_slots", "_usable", "_placed", "_starts", "_tails")
    )

    def numbers(section: Column, index: Column) -> Column:
        """The section's index, once for each number up to the next section's."""
        following = F.get(F.col("sections"), index + 1)["ordinal"]
        return F.array_repeat(index, F.coalesce(following - section["ordinal"], F.lit(1)))

    def place(number: Column) -> Column:
        first = F.get(F.col("sections"), F.lit(0))["ordinal"]
        at = F.least(F.coalesce(number, F.lit(0)) - first, F.size(slots) - 1)
        return F.coalesce(F.get(slots, F.greatest(at, F.lit(0))), F.lit(0))

    def run(start: Column, index: Column) -> Column:
        """Empty tails for sections without a caption, then the joined captions of one section."""
        before = F.coalesce(F.get(placed, F.get(starts, index - 1))["at"], F.lit(-1))
        end = F.coalesce(F.get(starts, index + 1), F.size(placed))
        texts = F.transform(
            F.slice(placed, start + 1, end - start),
            lambda c: F.concat(F.lit("\n\n" + CAPTION_PREFIX), c["caption"], F.lit("]")),
        )
        gap = F.array_repeat(F.lit(""), F.get(placed, start)["at"] - before - 1)
        return F.concat(gap, F.array(F.array_join(texts, "")))

    new = F.filter(
        F.sequence(F.lit(0), F.size(placed) - 1),
        lambda i: (i == 0) | (F.get(placed, i)["at"] != F.get(placed, i - 1)["at"]),
    )
    accepted_ones = F.coalesce(accepted(F.col("captions")), none)
    extended = F.transform(
        "sections",
        lambda s, i: F.struct(
            s["ordinal"].alias("ordinal"),
            s["heading"].alias("heading"),
            F.concat(
                s["text"], F.when(i < F.size(tails), F.get(tails, i)).otherwise(F.lit(""))
            ).alias("text"),
        ),
    )
    return (
        docs.withColumn("_usable", F.when(F.size("sections") > 0, accepted_ones).otherwise(none))
        .withColumn("_slots", F.flatten(F.transform("sections", numbers)))
        .withColumn(
            "_placed",
            F.sort_array(
                F.transform(
                    usable,
                    lambda c, k: F.struct(
                        place(c["section"]).alias("at"), k.alias("k"), c["caption"].alias("caption")
                    ),
                )
            ),
        )
        .withColumn(
            "_starts", F.when(F.size(placed) > 0, new).otherwise(F.array().cast("array<int>"))
        )
        .withColumn("_tails", F.flatten(F.transform(starts, run)))
        .withColumn("n_captions", F.size(usable))
        .withColumn("sections", extended)
        .drop("_usable", "_slots", "_placed", "_starts", "_tails")
    )


def with_sections(docs: DataFrame, body: Column) -> DataFrame:
    """Documents with at least one section, as an array.

    The generator of one row keeps the filter above it, so the body is split once;
    below a plain projection Spark would split it in the filter as well.
    """
    once = F.inline_outer(F.array(F.struct(X.sections(body).alias("sections"))))
    return docs.select("*", once).filter(F.size("sections") > 0)


def structure(docs: DataFrame) -> DataFrame:
    """Sections, captions and metadata defaults of clean documents; empty ones are dropped."""
    parsed = with_sections(docs, F.col("body"))
    title = F.coalesce("title", "slug")
    return (
        merge_captions(parsed)
        .withColumn("s", X.series_and_part(F.col("title")))
        .select(
            "doc_id",
            F.coalesce("source", F.lit("unknown")).alias("source"),
            "url",
            title.alias("title"),
            F.col("s.series").alias("series"),
            F.col("s.part").alias("part"),
            F.coalesce("language", F.lit("ko")).alias("language"),
            F.coalesce("doc_type", F.lit("article")).alias("doc_type"),
            "sections",
            "n_captions",
        )
    )


def internal_documents(docs: DataFrame) -> DataFrame:
    """Own Markdown files: the '# ' line is the title, no captions, no series."""
    heading = F.regexp_extract("body", r"\A# ([^\n]+)", 1)
    body = F.regexp_replace("body", r"\A# [^\n]+\n", "")
    none = F.lit(None).cast("string")
    return (
        with_sections(docs, body)
        .select(
            F.concat(F.lit("internal-"), "slug").alias("doc_id"),
            F.lit("internal_docs").alias("source"),
            none.alias("url"),
            F.when(heading != "", X.strip(heading)).otherwise(F.col("slug")).alias("title"),
            none.alias("series"),
            F.lit(None).cast("int").alias("part"),
            F.lit("ko").alias("language"),
            F.coalesce("doc_type", F.lit("article")).alias("doc_type"),
            "sections",
            F.lit(0).alias("n_captions"),
        )
    )


def build_documents(crawled: DataFrame, internal: DataFrame, excluded: DataFrame) -> DataFrame:
    """All structured documents except the excluded ones."""
    kept = crawled.join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")
    return structure(kept).unionByName(internal_documents(internal))


def doc_index(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", "source", "doc_type", "title", F.size("sections").alias("n_sections"), "n_captions"
    )
