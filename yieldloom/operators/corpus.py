"""Glossary cards and article chunks from structured documents.

Arrays that are costly to compute are expanded with the outer variants: from an
inner one Spark derives a filter on the array and computes it a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import text as X
from yieldloom.operators.documents import CAPTION_PREFIX
from yieldloom.operators.ranking import sequence_numbers

# Patterns of the corpus format.
SEE_PATTERN = r"""(?i)^See\s+[“"'‘]?(.+?)[”"'’]?\.?$"""
SEE_TAIL = r"""[”"'’.]+$"""
FOOTNOTE_PATTERN = r"(?md)^※\s*(.+?)\s*[:：]\s*(.+)$"
RESTART_PATTERN = r"\.\s+([A-Za-z][A-Za-z\-\s,;/]{1,45}?)\s+\(1\)"
SENSE_PATTERN = r"\.\s+\((\d+)\)\s*(\([^)]{0,60}\))?:?\s*"
INTRO_LABEL = "(서두)"
MIN_PROSE_CHARS = 15


def split_senses(term: Column, definition: Column) -> Column:
    """Numbered senses of a definition; text of another term that leaked in is cut first."""
    other = F.regexp_extract(definition, RESTART_PATTERN, 1)
    leak = (other != "") & ~F.startswith(X.canonical_term(other), X.canonical_term(term))
    at = F.regexp_instr(definition, F.lit(RESTART_PATTERN))
    own = F.concat(F.regexp_replace(F.substr(definition, F.lit(1), at - 1), r"[ .]+$", ""), F.lit("."))
    text = F.when(leak, own).otherwise(definition)

    pieces = F.split(F.regexp_replace(text, SENSE_PATTERN, "\u0001$2\u0002"), "\u0001")
    head = F.regexp_replace(X.strip(F.get(pieces, F.lit(0))), r"^\(\d+\)\s*", "")

    def sense(piece: Column) -> Column:
        qualifier = X.strip(F.substring_index(piece, "\u0002", 1))
        body = X.strip(F.substring_index(piece, "\u0002", -1))
        return F.when(body == "", "").otherwise(
            F.when(qualifier == "", body).otherwise(F.concat_ws(" ", qualifier, body))
        )

    later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), sense)
    senses = F.filter(F.concat(F.array(head), later), lambda s: s != "")
    whole = F.array(X.strip(text))
    return F.when((F.size(pieces) == 1) | (F.size(senses) == 0), whole).otherwise(senses)


def _card(term: Column, aliases: Column, definition: Column, how: str) -> list[Column]:
    return [
        X.canonical_term(term).alias("canonical_term"),
        term.alias("term"),
        aliases.alias("aliases"),
        definition.alias("definition"),
        F.col("source"),
        F.col("doc_id").alias("source_doc"),
        F.col("url").alias("source_url"),
        F.col("language"),
        F.lit(how).alias("extracted_by"),
        F.col("ordinal"),
        F.col("sense"),
    ]


def cards_from_glossary(docs: DataFrame, sense_sources: Sequence[str] = ()) -> DataFrame:
    """One card per headed section; sources with numbered senses give one card per sense."""
    entries = (
        docs.filter(F.col("doc_type") == "glossary")
        .select("doc_id", "source", "url", "language", F.inline_outer("sections"))
        .filter(F.col("heading").isNotNull())
        .withColumn("t", X.term_and_aliases(F.col("heading")))
    )
    text = X.strip(F.col("text"))
    definitions = F.when(
        F.col("source").isin(*sense_sources), split_senses(F.col("t.term"), text)
    ).otherwise(F.array(text))
    return entries.select("*", F.posexplode_outer(definitions).alias("sense", "definition")).select(
        *_card(F.col("t.term"), F.col("t.aliases"), F.col("definition"), "parsed")
    )


def cards_from_footnotes(docs: DataFrame) -> DataFrame:
    """'※ term: definition' lines of articles as cards."""
    notes = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(FOOTNOTE_PATTERN), F.lit(1)).alias("raw"),
        F.regexp_extract_all("text", F.lit(FOOTNOTE_PATTERN), F.lit(2)).alias("definition"),
    )
    rows = (
        docs.filter(F.col("doc_type") == "article")
        .select("doc_id", "source", "url", "language", F.inline_outer("sections"))
        .select("*", F.posexplode_outer(notes).alias("sense", "note"))
        .filter(F.col("note").isNotNull())
        .withColumn("t", X.term_and_aliases(F.col("note.raw")))
    )
    return rows.select(
        *_card(F.col("t.term"), F.col("t.aliases"), X.strip(F.col("note.definition")), "footnote")
    )


def see_target(definition: Column) -> Column:
    """Canonical term a 'See "X"' definition points to; null for other definitions."""
    stripped = X.strip(definition)
    target = X.strip(F.regexp_extract(stripped, SEE_PATTERN, 1))
    return F.when(
        stripped.rlike(SEE_PATTERN), X.canonical_term(F.regexp_replace(target, SEE_TAIL, ""))
    )


def see_aliases(cards: DataFrame) -> DataFrame:
    """Terms absorbed by the canonical term they refer to, one row per (term, alias).

    Aliases stay in long form next to the cards: a target that many terms refer
    to, or that has many cards, multiplies nothing.
    """
    references = (
        cards.withColumn("target", see_target(F.col("definition")))
        .filter(F.col("target").isNotNull() & (F.col("target") != F.col("canonical_term")))
        .select(F.col("target").alias("canonical_term"), F.col("term").alias("alias"))
        .distinct()
    )
    return references.join(
        cards.select("canonical_term").distinct(), "canonical_term", "left_semi"
    )


def resolve_see_refs(cards: DataFrame) -> DataFrame:
    """Cards with a definition of their own; pure references are dropped."""
    return cards.filter(see_target(F.col("definition")).isNull())


def absorbed_names(cards: DataFrame) -> DataFrame:
    """(id, alias): names that cards of their own take over from references, in long form."""
    return (
        resolve_see_refs(cards)
        .select("canonical_term", "id")
        .join(see_aliases(cards), "canonical_term")
        .select("id", "alias")
    )


def with_absorbed_names(cards: DataFrame) -> DataFrame:
    """Cards of their own, their aliases extended by the names of references to them, sorted.

    The names are gathered per target before the join, so a target with many cards
    multiplies no references.
    """
    none = F.array().cast("array<string>")
    names = see_aliases(cards).groupBy("canonical_term").agg(
        F.sort_array(F.collect_set("alias")).alias("_absorbed")
    )
    own = F.coalesce("aliases", none)
    new = F.array_except(F.coalesce("_absorbed", none), F.array_append(own, F.col("term")))
    return (
        resolve_see_refs(cards)
        .join(names, "canonical_term", "left")
        .withColumn("aliases", F.concat(own, new))
        .drop("_absorbed")
        .select(cards.columns)
    )


def see_report(cards: DataFrame) -> DataFrame:
    """How many cards were kept, absorbed as an alias, or dropped without a target."""
    known = cards.select(F.col("canonical_term").alias("target")).distinct().withColumn(
        "found", F.lit(True)
    )
    state = (
        F.when(F.col("target").isNull(), "kept")
        .when(F.col("found") & (F.col("target") != F.col("canonical_term")), "absorbed")
        .otherwise("dropped")
    )
    return (
        cards.withColumn("target", see_target(F.col("definition")))
        .join(known, "target", "left")
        .groupBy(state.alias("state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pack_paragraphs(text: Column, max_tokens: int) -> Column:
    """Greedy packing of paragraphs; a figure caption never opens a new part."""
    paragraphs = F.filter(F.split(text, "\n\n+"), lambda p: X.strip(p) != "")
    empty = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("buffer"),
        F.lit(0).alias("size"),
        F.lit(False).alias("open"),
    )

    def add(state: Column, paragraph: Column) -> Column:
        cost = X.token_estimate(paragraph)
        is_caption = F.startswith(X.strip(paragraph), F.lit(CAPTION_PREFIX.rstrip()))
        full = state["open"] & ~is_caption & (state["size"] + cost > max_tokens)
        joined = F.concat(state["buffer"], F.lit("\n\n"), paragraph)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["buffer"])))
            .otherwise(state["done"])
            .alias("done"),
            F.when(full | ~state["open"], paragraph).otherwise(joined).alias("buffer"),
            (F.when(full, 0).otherwise(state["size"]) + cost).cast("int").alias("size"),
            F.lit(True).alias("open"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["open"], F.concat(state["done"], F.array(state["buffer"]))
        ).otherwise(state["done"])

    return F.aggregate(paragraphs, empty, add, finish)


def chunk_sections(docs: DataFrame) -> DataFrame:
    """Article sections as chunks: whole up to the limit, else packed by paragraph."""
    rows = docs.filter(F.col("doc_type") == "article").select(
        "doc_id", "title", "source", "url", "series", "part", "language", F.inline_outer("sections")
    )
    text = F.col("text")
    parts = F.when(
        X.token_estimate(text) <= schemas.MAX_CHUNK_TOKENS, F.array(text)
    ).otherwise(pack_paragraphs(text, schemas.TARGET_SUB_TOKENS))
    heading = F.coalesce("heading", F.lit(INTRO_LABEL))
    counter = F.when(
        F.col("n_parts") > 1,
        F.concat(F.lit(" ("), F.col("piece") + 1, F.lit("/"), F.col("n_parts"), F.lit(")")),
    ).otherwise(F.lit(""))
    return (
        rows.filter(F.col("ordinal").isNotNull())
        .withColumn("parts", parts)
        .withColumn("n_parts", F.size("parts"))
        .select("*", F.posexplode_outer("parts").alias("piece", "chunk"))
        .filter(F.col("chunk").isNotNull())
        .select(
            "doc_id",
            "ordinal",
            "piece",
            F.concat(F.lit("["), "title", F.lit("] > "), heading, counter).alias("context_header"),
            X.strip(F.col("chunk")).alias("text"),
            "source",
            F.col("url").alias("source_url"),
            "series",
            "part",
            heading.alias("section"),
            "language",
            X.token_estimate(F.col("chunk")).alias("n_tokens"),
        )
    )


def corpus_id(prefix: str, number: Column) -> Column:
    """'card-0001'; numbers past 9999 keep all their digits."""
    text = number.cast("string")
    padded = F.lpad(text, 4, "0")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(text) < 4, padded).otherwise(text))


def assign_corpus_ids(records: DataFrame, prefix: str, doc: str, within: Sequence[str]) -> DataFrame:
    """Sequential ids in file order; files sort by their name with extension."""
    order = [F.concat(F.col(doc).cast("string"), F.lit(".json")), *map(F.col, within)]
    numbered = sequence_numbers(records, order, "_number")
    return numbered.withColumn("id", corpus_id(prefix, F.col("_number"))).drop("_number")


def embedding_text_card(term: Column, aliases: Column, definition: Column) -> Column:
    listed = F.when(
        F.size(aliases) > 0, F.concat(F.lit(" ("), F.array_join(aliases, ", "), F.lit(")"))
    ).otherwise(F.lit(""))
    return F.concat(term, listed, F.lit(": "), definition)


def embedding_text(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """The one text per record that is embedded, indexed and trained on."""
    from_cards = cards.select(
        "id",
        F.lit("glossary").alias("kind"),
        embedding_text_card(F.col("term"), F.col("aliases"), F.col("definition")).alias("text"),
    )
    from_chunks = chunks.select(
        "id", F.lit("article").alias("kind"), F.concat_ws("\n", "context_header", "text").alias("text")
    )
    return from_cards.unionByName(from_chunks)


def prose_chars(text: Column) -> Column:
    without = F.regexp_replace(text, r"(?s)\[그림 설명:.*?\]", "")
    return F.length(X.strip(F.regexp_replace(without, r"▲[^\n]*", "")))


def corpus_stats(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """Corpus report in long form (metric, name, value)."""

    def grid(frame: DataFrame, kind: str, *columns: str) -> DataFrame:
        """Total and one-column breakdowns from one aggregation."""
        sets = [[], *[[F.col(c)] for c in columns]]
        metric, name = F.lit(kind), F.lit("")
        for column in columns:
            inside = F.grouping(column) == 0
            metric = F.when(inside, F.lit(f"{kind}_by_{column}")).otherwise(metric)
            name = F.when(inside, F.col(column)).otherwise(name)
        return frame.groupingSets(sets, *columns).agg(
            F.count(F.lit(1)).cast("double").alias("value"),
            metric.alias("metric"),
            name.alias("name"),
        ).select("metric", "name", "value")

    repeated = (
        cards.groupBy("canonical_term").count().filter("count > 1")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit("duplicate_terms").alias("metric"), F.lit("").alias("name"), "value")
    )
    sizes = chunks.agg(
        F.min("n_tokens").cast("double").alias("min"),
        F.max("n_tokens").cast("double").alias("max"),
        F.round(F.avg("n_tokens"), 1).alias("mean"),
        F.count_if(prose_chars(F.col("text")) < MIN_PROSE_CHARS).cast("double").alias("caption_only"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("chunk_tokens" if n != "caption_only" else "chunks").alias("metric"),
                        F.lit(n).alias("name"),
                        F.col(n).alias("value"),
                    )
                    for n in ("min", "max", "mean", "caption_only")
                ]
            )
        )
    )
    return (
        grid(cards, "cards", "source", "extracted_by")
        .unionByName(grid(chunks, "chunks", "source"))
        .unionByName(repeated)
        .unionByName(sizes)
    )
