"""Text expressions. All but NFC normalisation stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points below U+0300 are their own NFC form and never combine with each other.
NFC_SAFE = r"^[\x{0}-\x{2FF}]*$"

# Token runs for keyword search, and question types of article questions.
TOKEN_PATTERN = "[0-9A-Za-z_]+|[가-힣]+"
QUESTION_TYPES = ("concept", "flow", "judgment")

# Accepted spellings of defect names without a bracketed form.
DEFECT_SYNONYMS = {
    "몰딩 온도 스펙 이탈": ["몰딩 온도 스펙 이탈", "몰드 온도 스펙 이탈", "몰딩 온도 이탈"],
}


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC form; only text that can change is sent to Python."""
    safe = text.rlike(NFC_SAFE)
    return F.when(safe, text).otherwise(_nfc(F.when(~safe, text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """NFC, no-break blanks, stray markup, inner line breaks and runs of blanks."""
    clean = F.replace(nfc(text), F.lit("\u00a0"), F.lit(" "))
    clean = F.replace(clean, F.lit("/p>"), F.lit(""))
    clean = F.regexp_replace(clean, r"\s*\n\s*", " ")
    clean = F.regexp_replace(clean, r"[ \t]+", " ")
    return strip(clean)


def canonical_term(term: Column) -> Column:
    """Blanks collapsed, trimmed, lower case."""
    return F.lower(strip(F.regexp_replace(term, r"\s+", " ")))


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin word characters or Hangul syllables."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Two characters count as one token."""
    return F.floor(F.length(text) / 2).cast("int")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    cut = F.instr(text, "\n")
    return F.when(cut > 0, F.substr(text, cut + 1)).otherwise(F.lit(""))


def url_slug(url: Column) -> Column:
    """Last path part of a URL as a file name."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.substring_index(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)
    slug = F.regexp_replace(last, "[^A-Za-z0-9._-]", "_")
    return F.when(slug == "", "index").otherwise(slug)


def term_and_aliases(raw: Column) -> Column:
    """'Yield (a, b)' -> struct(term 'Yield', aliases [a, b]); full-width brackets too."""
    pattern = r"^(.*?)\s*[（(]([^）)]+)[）)]\s*$"
    base = strip(F.regexp_extract(raw, pattern, 1))
    parts = F.transform(F.split(F.regexp_extract(raw, pattern, 2), "[,/]"), strip)
    aliases = F.filter(parts, lambda part: part != "")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(base != "", base).otherwise(strip(raw)).alias("term"),
        F.when(base != "", aliases).otherwise(none).alias("aliases"),
    )


def sections(body: Column) -> Column:
    """Sections of a Markdown body as array<struct<ordinal, heading, text>>.

    Text before the first heading is section 0 without a heading. Headings keep
    their number when an empty section before them is dropped.
    """
    parts = F.split(body, r"(?md)^## (?=.)")
    intro = F.struct(
        F.lit(0).alias("ordinal"),
        F.lit(None).cast("string").alias("heading"),
        strip(F.get(parts, F.lit(0))).alias("text"),
    )
    headed = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part, i: F.struct(
            (i + 1).alias("ordinal"),
            strip(first_line(part)).alias("heading"),
            strip(after_first_line(part)).alias("text"),
        ),
    )
    return F.filter(
        F.concat(F.array(intro), headed),
        lambda s: (s["text"] != "") & (s["heading"].isNull() | (s["heading"] != "")),
    )


def section_count(body: Column) -> Column:
    return F.size(F.split(body, r"(?md)^## (?=.)")) - 1


def series_and_part(title: Column) -> Column:
    """'[Name 2편] ...' -> struct(series 'Name', part 2); other bracket text -> (text, null)."""
    numbered = r"\[([^\]\d]+?)\s*(\d+)편[^\]]*\]"
    bracket = r"\[([^\]]+)\]"
    name = F.regexp_extract(title, numbered, 1)
    plain = F.regexp_extract(title, bracket, 1)
    return F.struct(
        F.when(name != "", strip(name)).when(plain != "", strip(plain)).alias("series"),
        F.when(name != "", F.regexp_extract(title, numbered, 2).try_cast("int")).alias("part"),
    )


def question_type(found: Column, source_type: Column) -> Column:
    """Cards always ask for a term; unknown types of articles become 'concept'."""
    return (
        F.when(source_type == "glossary_card", "term")
        .when(found.isin(*QUESTION_TYPES), found)
        .otherwise("concept")
    )


def defect_name_variants(name: Column) -> Column:
    """'A (B)' -> [name, A, B]; listed names have fixed spellings."""
    base = strip(F.substring_index(name, "(", 1))
    inner = strip(F.regexp_extract(name, r"\(([^(]*)\)$", 1))
    bracketed = name.contains("(") & name.endswith(")")
    variants = F.when(
        bracketed, F.filter(F.array(name, base, inner), lambda v: v != "")
    ).otherwise(F.array(name))
    for known, spellings in DEFECT_SYNONYMS.items():
        variants = F.when(name == known, F.array(*map(F.lit, spellings))).otherwise(variants)
    return variants


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Case-insensitive containment of at least one keyword."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | lowered.contains(keyword.lower())
    return hit
