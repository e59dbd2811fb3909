"""Record keeping of collected pages, keyword selection and corpus merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import text as X
from yieldloom.functions.guards import choose
from yieldloom.operators.ranking import sequence_numbers

# Words that mark a term as a packaging or test term.
DOMAIN_KEYWORDS = (
    "package", "packaging", "assembly", "bond", "bonding", "bump", "solder",
    "mold", "molding", "encapsulant", "encapsulation", "underfill", "die",
    "wafer", "substrate", "leadframe", "lead", "flip chip", "ball grid",
    "chip scale", "interposer", "singulation", "dicing", "grinding",
    "burn-in", "test", "probe", "socket", "handler", "delamination",
    "warpage", "coplanarity", "moisture", "reliability", "thermal",
    "BGA", "CSP", "WLP", "TSV", "PoP", "SiP", "stack", "via",
)


#: What a record says of a fetch besides its content.
DETAILS = ("title", "fetched_at", "note")


def fetch_records(pages: DataFrame) -> DataFrame:
    """Manifest fields of fetched content: (source, url, content, seq, status) and ``DETAILS``.

    A detail that is missing is null. Without content a fetch has failed: no file, no
    digest, no bytes, status ``failed``, and the note says why.
    """
    got = F.col("content").isNotNull()
    file = F.concat("source", F.lit("/"), X.url_slug(F.col("url")), F.lit(".html"))
    return pages.select(
        "source",
        "url",
        F.when(got, file).alias("file"),
        F.sha2("content", 256).alias("sha256"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"),
        F.when(got, F.col("status")).otherwise("failed").alias("status"),
        "seq",
        *[(F.col(c) if c in pages.columns else F.lit(None)).cast("string").alias(c) for c in DETAILS],
    )


def manifest_upsert(existing: DataFrame, fetched: DataFrame, mode: str = "replace") -> DataFrame:
    """One record per URL, whole: the latest fetch replaces, or the existing record stays.

    A pre-aggregated maximum instead of a sort per URL, so a URL that was
    fetched very often stays cheap.
    """
    old, new = (0, 1) if choose(mode, ["replace", "keep"], "mode") == "replace" else (1, 0)
    rows = existing.withColumn("_level", F.lit(old)).unionByName(
        fetched.withColumn("_level", F.lit(new)), allowMissingColumns=True
    )
    if mode == "replace":
        rank = F.struct("_level", "seq", "sha256")
    else:
        rank = F.struct("_level", (-F.col("seq")).alias("early"), "sha256")
    record = F.struct(*[c for c in rows.columns if c not in ("url", "_level")])
    return rows.groupBy("url").agg(F.max_by(record, rank).alias("r")).select("url", "r.*")


def manifest_status_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def keyword_select(
    titles: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Every title with its decision; rejected ones keep the reason."""
    wanted = X.contains_any(F.col("title"), include)
    barred = X.contains_any(F.col("title"), exclude)
    reason = F.when(barred, "excluded_keyword").when(~wanted, "no_keyword")
    return titles.withColumn("reason", reason).withColumn(
        "status", F.when(reason.isNull(), "selected").otherwise("candidate_skipped")
    )


def term_pattern(keywords: Sequence[str]) -> str:
    """One pattern for all keywords, each bounded by non-letters."""
    special = set(r".\+*?[^]$(){}=!<>|-")
    escaped = (
        "".join(f"\\{c}" if c in special else c for c in keyword.lower()) for keyword in keywords
    )
    return f"(?<![a-z])({'|'.join(escaped)})(?![a-z])"


def term_keyword_filter(
    terms: DataFrame, keywords: Sequence[str] = DOMAIN_KEYWORDS
) -> DataFrame:
    return terms.filter(F.lower("term").rlike(term_pattern(keywords)))


def term_filter_totals(
    terms: DataFrame, keywords: Sequence[str] = DOMAIN_KEYWORDS
) -> DataFrame:
    """How many terms were found and how many the keyword filter keeps, in one pass."""
    kept = F.lower("term").rlike(term_pattern(keywords))
    return terms.agg(F.count(F.lit(1)).alias("found"), F.count_if(kept).alias("kept"))


def listing_dedupe(listing: DataFrame, held: DataFrame) -> DataFrame:
    """First listing row per URL by (tag, page, pos), without URLs that are already held."""
    place = F.struct("tag", "page", "pos")
    first = listing.groupBy("url").agg(
        F.min_by(F.struct("tag", "page", "pos", "title"), place).alias("first")
    )
    return first.join(held.select("url").distinct(), "url", "left_anti").select("url", "first.*")


def replace_by_source(
    corpus: DataFrame, fresh: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Drop the sources that are merged again, append the new rows, number on from the last id."""
    again = fresh.select("source").distinct()
    kept = corpus.join(again, "source", "left_anti").select("id", "source", "title", "text")
    last = kept.agg(F.max(F.substr("id", F.lit(2)).cast("long")).alias("last"))
    numbered = sequence_numbers(fresh, order, "_number", start=1).withColumn(
        "_number", F.col("_number") + F.coalesce(last.scalar(), F.lit(0))
    )
    return kept.unionByName(
        numbered.select(document_id(F.col("_number")).alias("id"), "source", "title", "text")
    )


def document_id(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("d"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def corpus_titles(corpus: DataFrame) -> DataFrame:
    """id, source and title as one tab-separated line."""
    return corpus.select(F.concat_ws("\t", "id", "source", "title").alias("line"))
