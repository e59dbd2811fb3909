"""The training-data operators as registered queries, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import (
    decision_list,
    exact_dedup,
    kneser_ney,
    license_scan,
    line_runs,
    mixing,
    neighbour_quality,
    packing,
    phrases,
    pii,
    secret_scan,
    simhash,
    token_alignment,
)
from yieldloom.llm.common import written
from yieldloom.llm.spans import base_digest, counted, listed

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where a vocabulary file is; the other queries work without this package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(id_col: Column) -> Column:
    """Remainder that says which rows a model may learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with their ids and checksum."""
    rows = packing.pack(
        docs, vocabulary(TOKENIZER), vocabulary(RANKS)
    )
    return rows.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packed(documents(spark, sf_dir)).drop("ids")


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = mixing.mix(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        "repeats",
    )


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules and the learned list on each document."""
    docs = documents(spark, sf_dir)
    rules = decision_list.fit(docs, labels(spark, sf_dir))
    return decision_list.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *[
            f"_quality.{name}"
            for name in (
                "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept rule"
            ).split()
        ],
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document, and a digest of what stays."""
    rows = line_runs.dedupe_lines(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of each document."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in each document."""
    spans = F.col("spans")
    found = secret_scan.scan_secrets(documents(spark, sf_dir), vocabulary(RANKS))
    return found.select(
        "doc_id",
        *[counted(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        base_digest(spans).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document under a model of four fifths of them."""
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id")) == 1
    model = kneser_ney.train(docs.filter(~held_out))
    return kneser_ney.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by its nearest labelled neighbours."""
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id")) == 0
    model = neighbour_quality.fit(docs, labels(spark, sf_dir).filter(~held_out))
    return neighbour_quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= neighbour_quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in each document."""
    spans = F.col("spans")
    return pii.scan_personal_data(documents(spark, sf_dir)).select(
        "doc_id",
        *[counted(spans, kind).alias(f"n_{kind}") for kind in pii.BASE],
        base_digest(spans).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def both_tokenizers() -> tuple[str, str, str]:
    return tuple(map(vocabulary, (TOKENIZER, RANKS, PIECES)))


def aligned(docs: DataFrame) -> DataFrame:
    """Groups and links of two tokenizers, with counts over all of ``docs``."""
    files, groups = both_tokenizers(), F.col("groups")
    digest = F.when(F.col("n_a") > 0, F.sha2(groups.cast("binary"), 256)).otherwise("")
    rows = token_alignment.align(docs, *files).withColumn("groups_sha256", digest).drop("groups")
    rows = written(rows, "aligned")
    counts = token_alignment.link_counts(rows, *files)
    return token_alignment.with_counts(rows, counts, *files).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        "groups_sha256",
        "n_overlaps",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in each document."""
    return aligned(documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in each document."""
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("notices")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return phrases.collocations(documents(spark, sf_dir))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_line_runs": f"""
WITH rows AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM rows
), keyed AS (
  SELECT doc_id, rid, line, pos,
         {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), marked AS (
  SELECT k.doc_id, k.rid, k.line, k.pos, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
""",
    "op5_exact_dedup": f"""
WITH digests AS (
  SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
""",
    "op13_phrase_collocations": phrases.oracle(),
    "op12_license_scan": license_scan.oracle(license_scan.template_grams()),
}

QUERIES = {
    query.__name__: query
    for query in (
        op1_harmonic_packing,
        op2_cube_mixing,
        op3_decision_list,
        op4_line_runs,
        op5_exact_dedup,
        op6_simhash,
        op7_secret_scan,
        op8_kneser_ney,
        op9_neighbour_quality,
        op10_personal_data,
        op11_token_alignment,
        op12_license_scan,
        op13_phrase_collocations,
    )
}
