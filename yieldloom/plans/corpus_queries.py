"""Registered corpus, page, manifest and caption analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import text as X
from yieldloom.operators import captions, corpus, documents, manifest, pages, retrieval
from yieldloom.sources import corpus_files, manifest_store, tables

TITLE_INCLUDE = ("ring", "widget", "plate")
TITLE_EXCLUDE = ("red", "hot")
TERM_WORDS = ("the", "und", "que", "los")
CAPTION_PATTERNS = captions.RiskPatterns(
    suspect="token|@|[0-9]{4}", flow="and |puis|dann", structure="the |der |les "
)


def _md5(name: str) -> F.Column:
    return F.md5(F.col(name))


def read_corpus_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as chunk lines and read back with the fixed schema."""
    lines = tables.texts(spark, folder).select(
        F.to_json(
            F.struct(
                F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")).alias("id"),
                F.col("doc_id").cast("string").alias("doc_id"),
                "text",
                "source",
                F.col("lang").alias("language"),
                (F.col("n_chars") / 2).cast("int").alias("n_tokens"),
            )
        ).alias("line")
    )
    rows = corpus_files.parse_corpus_lines(lines, schemas.CHUNK)
    return rows.select("id", "doc_id", _md5("text").alias("text_md5"), "source", "series", "language", "n_tokens")


def read_clean_docs(spark: SparkSession, folder: str) -> DataFrame:
    files = tables.texts(spark, folder).select(
        "doc_id",
        F.concat(
            F.lit("---\ntitle: "),
            X.first_line(F.col("text")),
            F.lit("\nsource: "),
            "source",
            F.lit("\nurl: \nlanguage: xx\nlanguage: "),
            "lang",
            F.lit("\n---\n"),
            "text",
        ).alias("content"),
    )
    rows = corpus_files.split_front_matter(files)
    return rows.select(
        "doc_id",
        F.col("meta")["title"].alias("title"),
        F.col("meta")["source"].alias("source"),
        F.col("meta")["url"].alias("url"),
        F.col("meta")["language"].alias("language"),
        F.size("meta").alias("n_meta"),
        _md5("body").alias("body_md5"),
    )


def _records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records of all listed pages, and those of the pages that were fetched."""
    listing = tables.page_listing(spark, folder)
    existing = manifest.fetch_records(
        listing.select(
            "source", "url", F.col("title").alias("content"), F.col("page_id").alias("seq"),
            F.lit("candidate").alias("status"), "title",
        )
    )
    skipped = F.col("title").contains("%%%")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    picked = listing.filter(F.col("tag").isin("en", "fr", "de")).select(
        "source",
        "url",
        "content",
        F.col("page_id").alias("seq"),
        F.when(skipped, "candidate_skipped").otherwise("downloaded").alias("status"),
        "title",
        day.cast("string").alias("fetched_at"),
        F.when(skipped, F.concat(F.lit("tag "), F.col("tag"))).alias("note"),
    )
    return existing, manifest.fetch_records(picked)


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_upsert(*_records(spark, folder))


def stored_manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The same on a stored manifest, read back after the update."""
    existing, fetched = _records(spark, folder)
    # A listing may name an address twice; a store holds one record of each.
    listed = manifest.manifest_upsert(existing, existing.limit(0))
    store = manifest_store.new_store(listed)
    store.upsert(fetched)
    return store.read(spark)


def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder)


def manifest_status_summary(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_status_summary(_manifest(spark, folder))


def keyword_select(spark: SparkSession, folder: str) -> DataFrame:
    titles = tables.read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title")
    )
    return manifest.keyword_select(titles, TITLE_INCLUDE, TITLE_EXCLUDE)


def term_keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.term_keyword_filter(tables.text_lines(spark, folder), TERM_WORDS)


def term_filter_totals(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.term_filter_totals(tables.text_lines(spark, folder), TERM_WORDS)


def listing_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    listing = tables.page_listing(spark, folder)
    rows = listing.select(
        "url", "tag", F.lit(1).alias("page"), F.col("page_id").alias("pos"), "title"
    )
    held = listing.filter(F.col("title").contains("%%%")).select("url")
    return manifest.listing_dedupe(rows, held)


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).select(
        manifest.document_id(F.col("doc_id") + 1).alias("id"),
        "source",
        X.first_line(F.col("text")).alias("title"),
        "text",
    )


def replace_by_source(spark: SparkSession, folder: str) -> DataFrame:
    fresh = tables.read_table(spark, folder, "benchmark").select(
        "item_id",
        F.concat(F.lit("src"), F.length("text") % 3).alias("source"),
        X.first_line(F.col("text")).alias("title"),
        "text",
    )
    rows = manifest.replace_by_source(_corpus(spark, folder), fresh, ["source", "item_id"])
    return rows.select("id", "source", "title", _md5("text").alias("text_md5"))


def corpus_titles(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.corpus_titles(_corpus(spark, folder))


def caption_risk_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = captions.caption_risk_class(tables.page_captions(spark, folder), CAPTION_PATTERNS)
    return rows.select("src", "slug", "section", "category", "priority")


def caption_status_summary(spark: SparkSession, folder: str) -> DataFrame:
    return captions.caption_status_summary(tables.page_captions(spark, folder), CAPTION_PATTERNS)


def apply_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    rows = captions.apply_exclusions(
        tables.page_captions(spark, folder), tables.toxic_images(spark, folder)
    )
    return rows.select("src", "slug", "section", "status")


def exclusion_report(spark: SparkSession, folder: str) -> DataFrame:
    return captions.exclusion_report(
        tables.page_captions(spark, folder), tables.toxic_images(spark, folder)
    )


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents.normalize_documents(tables.texts(spark, folder))
    return rows.select("doc_id", F.length("text").alias("chars"), _md5("text").alias("text_md5"))


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = pages.page_blocks(tables.article_pages(spark, folder), pages.ARTICLE)
    return blocks.select("page_id", "pos", "section", "kind", "text")


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean documents of the pages with their metadata."""
    meta = tables.page_listing(spark, folder).select("page_id", "url", "source")
    clean = pages.clean_documents(tables.article_pages(spark, folder), pages.ARTICLE)
    return clean.join(meta, "page_id").withColumn("doc_type", F.lit("article"))


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder)


def clean_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The quality gate on documents made from pages."""
    return documents.quality_gate(_clean(spark, folder).withColumnRenamed("page_id", "doc_id"))


def clean_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of documents made from pages."""
    docs = _clean(spark, folder).withColumnRenamed("page_id", "doc_id")
    return documents.split_sections(docs).select("doc_id", "ordinal", "heading", _md5("text").alias("text_md5"))


def block_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return documents.block_dedupe(tables.line_blocks(spark, folder))


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_images(
        pages.page_blocks(tables.illustrated_pages(spark, folder), pages.ARTICLE)
    )


def glossary_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pages.glossary_pairs(tables.definition_blocks(spark, folder))
    return pairs.withColumn("definition", _md5("definition"))


def glossary_from_spans(spark: SparkSession, folder: str) -> DataFrame:
    return pages.glossary_from_spans(tables.spans(spark, folder))


def doc_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return documents.quality_gate(tables.markdown_docs(spark, folder))


def split_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents.split_sections(tables.markdown_docs(spark, folder))
    return rows.select("doc_id", "ordinal", "heading", _md5("text").alias("text_md5"))


def md_header_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents.md_header_sections(tables.markdown_docs(spark, folder))
    return rows.select("doc_id", "title", _md5("text").alias("text_md5"))


def parse_series(spark: SparkSession, folder: str) -> DataFrame:
    return documents.parse_series(tables.markdown_docs(spark, folder))


def merge_captions(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.caption_docs(spark, folder).withColumn("sections", X.sections(F.col("body")))
    rows = documents.merge_captions(docs).select("doc_id", "n_captions", F.inline_outer("sections")
    ).filter(F.col("ordinal").isNotNull())
    return rows.select("doc_id", "n_captions", "ordinal", _md5("text").alias("text_md5"))


def _built(spark: SparkSession, folder: str) -> DataFrame:
    crawled = tables.caption_docs(spark, folder).withColumn(
        "doc_id", F.concat_ws("-", "source", "slug")
    )
    excluded = documents.quality_gate(crawled).filter(~F.col("include"))
    return documents.build_documents(crawled, tables.internal_docs(spark, folder), excluded)


def build_documents(spark: SparkSession, folder: str) -> DataFrame:
    content = F.array_join(
        F.transform("sections", lambda s: F.concat_ws("|", s["heading"], s["text"])), "||"
    )
    return _built(spark, folder).withColumn("content_md5", F.md5(content)).drop("sections")


def doc_index(spark: SparkSession, folder: str) -> DataFrame:
    return documents.doc_index(_built(spark, folder))


def term_aliases(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(
        F.col("p_size") <= 30, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" / "), "p_type", F.lit(")"))
    ).otherwise(F.concat("p_name", F.lit("（"), "p_type", F.lit("） ")))
    rows = tables.read_table(spark, folder, "part").select(
        "p_partkey", X.term_and_aliases(raw).alias("t")
    )
    return rows.select("p_partkey", "t.term", F.array_join("t.aliases", "|").alias("aliases"))


def split_senses(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.glossary_docs(spark, folder).select("doc_id", F.inline_outer("sections"))
    senses = corpus.split_senses(F.col("heading"), F.col("text"))
    return docs.select("doc_id", F.posexplode_outer(senses).alias("sense", "text")).select(
        "doc_id", "sense", _md5("text").alias("text_md5")
    )


def cards_from_glossary(spark: SparkSession, folder: str) -> DataFrame:
    cards = corpus.cards_from_glossary(
        tables.glossary_docs(spark, folder), sense_sources=("src1", "src2")
    )
    return cards.select(
        "canonical_term",
        "term",
        F.array_join("aliases", "|").alias("aliases"),
        _md5("definition").alias("definition_md5"),
        "source",
        "source_doc",
        "sense",
    )


def _footnote_cards(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.cards_from_footnotes(tables.footnote_docs(spark, folder))


def cards_from_footnotes(spark: SparkSession, folder: str) -> DataFrame:
    return _footnote_cards(spark, folder).select(
        "source_doc", "canonical_term", "term", _md5("definition").alias("definition_md5")
    )


def resolve_see_refs(spark: SparkSession, folder: str) -> DataFrame:
    cards = tables.part_cards(spark, folder)
    kept = corpus.resolve_see_refs(cards).select(
        F.lit("card").alias("kind"), "canonical_term", F.col("term").alias("value"), "id"
    )
    absorbed = corpus.see_aliases(cards).select(
        F.lit("alias").alias("kind"),
        "canonical_term",
        F.col("alias").alias("value"),
        F.lit(None).cast("long").alias("id"),
    )
    return kept.unionByName(absorbed)


def see_embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the cards with the names they absorb."""
    cards = corpus.with_absorbed_names(tables.part_cards(spark, folder))
    text = corpus.embedding_text_card(F.col("term"), F.col("aliases"), F.col("definition"))
    return cards.select("id", F.size("aliases").alias("n_aliases"), F.md5(text).alias("text"))


def see_term_index(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that lead to a card, absorbed names included."""
    cards = tables.part_cards(spark, folder)
    index = retrieval.term_index(corpus.resolve_see_refs(cards), corpus.absorbed_names(cards))
    return index.select("key", "id")


def see_report(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.see_report(tables.part_cards(spark, folder))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk_sections(tables.paragraph_docs(spark, folder))


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select(
        "doc_id", "piece", "n_tokens", "context_header", _md5("text").alias("text_md5")
    )


def assign_corpus_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder).select("doc_id", "ordinal", "piece")
    return corpus.assign_corpus_ids(rows, "chunk", "doc_id", ["ordinal", "piece"]).select(
        "id", "doc_id", "piece"
    )


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus_stats(tables.part_cards(spark, folder), _chunks(spark, folder))


def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    cards = tables.part_cards(spark, folder).withColumn("id", F.concat(F.lit("card-"), "id"))
    chunks = tables.markdown_docs(spark, folder).select(
        F.concat(F.lit("chunk-"), "doc_id").alias("id"),
        F.col("title").alias("context_header"),
        F.col("body").alias("text"),
    )
    return corpus.embedding_text(cards, chunks).withColumn("text", _md5("text"))


QUERIES = {
    f.__name__: f
    for f in (
        read_corpus_jsonl,
        read_clean_docs,
        manifest_upsert,
        stored_manifest_upsert,
        manifest_status_summary,
        keyword_select,
        term_keyword_filter,
        term_filter_totals,
        listing_dedupe,
        replace_by_source,
        corpus_titles,
        caption_risk_class,
        caption_status_summary,
        apply_exclusions,
        exclusion_report,
        normalize_text,
        page_blocks,
        clean_documents,
        clean_gate,
        clean_sections,
        block_dedupe,
        page_images,
        glossary_pairs,
        glossary_from_spans,
        doc_quality_gate,
        split_sections,
        md_header_sections,
        parse_series,
        merge_captions,
        build_documents,
        doc_index,
        term_aliases,
        split_senses,
        cards_from_glossary,
        cards_from_footnotes,
        resolve_see_refs,
        see_embedding_text,
        see_term_index,
        see_report,
        chunk_sections,
        assign_corpus_ids,
        corpus_stats,
        embedding_text,
    )
}


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


FIRST = "string_split(text, chr(10))[1]"

MD_SQL = """md AS (
  SELECT doc_id, 'doc-' || doc_id AS slug, source, lang,
         'https://docs.example.com/' || lang || '/' || doc_id AS url,
         CASE lang WHEN 'en' THEN '[EN 시리즈 ' || n_chars || '편] '
                   WHEN 'de' THEN '[' || source || '] ' ELSE '' END
           || string_split(text, chr(10))[1] AS title,
         CASE WHEN source = 'src0' THEN 'glossary' ELSE 'article' END AS doc_type,
         regexp_replace(text, '\\n([^\\n]{1,40})\\n', chr(10) || '## \\1' || chr(10), 'g') AS body
  FROM documents)"""


def sections_sql(docs: str, key: str) -> str:
    """Sections by a running heading count over lines, unlike the in-row split of the operator."""
    return f"""lines AS (
  SELECT {key}, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS n FROM {docs}),
marked AS (
  SELECT *, line LIKE '## _%' AS is_head,
         sum(CASE WHEN line LIKE '## _%' THEN 1 ELSE 0 END)
           OVER (PARTITION BY {key} ORDER BY n) AS ordinal FROM lines),
grouped AS (
  SELECT {key}, ordinal::INT AS ordinal,
         max({strip_sql("substr(line, 4)")}) FILTER (is_head) AS heading,
         {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_head), '')")} AS text
  FROM marked GROUP BY {key}, ordinal),
sections AS (SELECT * FROM grouped WHERE text <> '' AND (heading IS NULL OR heading <> ''))"""


NORMALIZED = strip_sql(
    "regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(160), ' '), '/p>', ''), "
    "'\\s*\\n\\s*', ' ', 'g'), '[ \\t]+', ' ', 'g')"
)

PAGE_SQL = """listing AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '//(m|blog)\\.', '//') AS url,
         regexp_extract(url, '//[^/]+/([^/]+)/', 1) AS tag,
         regexp_extract(url, '//([^/]+)/', 1) AS source,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages)"""

MANIFEST_SQL = f"""{PAGE_SQL}, records AS (
  SELECT 0 AS level, 'candidate' AS status, page_id AS seq, source, url, title AS content, title,
         CAST(NULL AS VARCHAR) AS fetched_at, CAST(NULL AS VARCHAR) AS note FROM listing
  UNION ALL
  SELECT 1, CASE WHEN contains(title, '%%%') THEN 'candidate_skipped' ELSE 'downloaded' END,
         page_id, source, url, html, title,
         strftime(DATE '2025-01-01' + (page_id % 365)::INT, '%Y-%m-%d'),
         CASE WHEN contains(title, '%%%') THEN 'tag ' || tag END FROM listing WHERE tag IN ('en', 'fr', 'de')),
manifest AS (
  SELECT url, source,
         source || '/' || CASE WHEN slug = '' THEN 'index' ELSE slug END || '.html' AS file,
         sha256(content) AS sha256, strlen(content)::BIGINT AS bytes, status, seq, title, fetched_at, note
  FROM (SELECT *, regexp_replace(regexp_extract(
                    regexp_replace(regexp_extract(url, '^[^:]+://[^/]*(.*)$', 1), '/+$', ''),
                    '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS slug,
               row_number() OVER (PARTITION BY url ORDER BY level DESC, seq DESC,
                                  sha256(content) DESC) AS rn
        FROM records) WHERE rn = 1)"""

LINES_SQL = """lines AS (
  SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS caption,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS section FROM documents)"""

CAPTIONS_SQL = LINES_SQL + """, captions AS (
  SELECT '/img/' || source || '/' || doc_id || '/' || section || '.png' AS src, 'doc-' || doc_id AS slug,
         section, caption, doc_id,
         CASE WHEN lang = 'de' THEN 'download_failed' WHEN lang = 'es' THEN 'error: ' || source
              WHEN n_chars < 200 THEN 'svg_skipped' ELSE 'ok' END AS status FROM lines),
classed AS (
  SELECT *, CASE WHEN length(caption) < 50 OR regexp_matches(caption, 'token|@|[0-9]{4}') THEN 'suspect'
                 WHEN regexp_matches(caption, 'and |puis|dann') THEN 'flow'
                 WHEN regexp_matches(caption, 'the |der |les ') THEN 'structure'
                 ELSE 'other' END AS category
  FROM captions WHERE status = 'ok' AND caption <> '')"""

GLOSSARY_SQL = """glossary AS (
  SELECT doc_id, source, lang,
         array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:2], ' ') AS base,
         '(1) ' || replace(text, '.' || chr(10), '. (2) (in use): ') AS text FROM documents)"""


def senses_sql(heading: str) -> str:
    restart = r"\.\s+([A-Za-z][A-Za-z\-\s,;/]{1,45}?)\s+\(1\)"
    sense = r"\.\s+\((\d+)\)\s*(\([^)]{0,60}\))?:?\s*"
    return rf"""cut AS (
  SELECT *, CASE WHEN other <> '' AND NOT starts_with(
                        lower({strip_sql(r"regexp_replace(other, '\s+', ' ', 'g')")}),
                        lower({strip_sql(rf"regexp_replace({heading}, '\s+', ' ', 'g')")}))
                 THEN regexp_replace(substr(text, 1, strpos(text, whole) - 1), '[ .]+$', '') || '.'
                 ELSE {strip_sql('text')} END AS def
  FROM (SELECT *, regexp_extract(text, '{restart}', 1) AS other,
               regexp_extract(text, '{restart}') AS whole FROM glossary)),
pieces AS (
  SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS n, len(parts) AS total
  FROM (SELECT *, string_split(regexp_replace(def, '{sense}', chr(1) || '\2' || chr(2), 'g'), chr(1))
               AS parts FROM cut)),
spoken AS (
  SELECT *, CASE WHEN total = 1 THEN {strip_sql('def')}
                 WHEN n = 1 THEN regexp_replace({strip_sql('part')}, '^\(\d+\)\s*', '')
                 WHEN {strip_sql("string_split(part, chr(2))[2]")} = '' THEN ''
                 ELSE {strip_sql("string_split(part, chr(2))[1] || ' ' || " + strip_sql("string_split(part, chr(2))[2]"))}
            END AS sense_text FROM pieces),
senses AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS sense
  FROM spoken WHERE sense_text <> '')"""


CARDS_SQL = """cards AS (
  SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS canonical_term,
         p_name || ' ' || p_brand AS term, p_brand, p_type, p_size, p_type AS source,
         CASE WHEN p_size <= 10 THEN 'See "' || upper(p_name) || ' Brand#1".'
              ELSE p_type || ' ' || p_size END AS definition,
         CASE WHEN p_size <= 10 THEN lower(p_name || ' Brand#1') END AS target,
         CASE WHEN p_size <= 25 THEN 'parsed' ELSE 'footnote' END AS extracted_by FROM part)"""

ABSORBED_SQL = """kept AS (SELECT * FROM cards WHERE target IS NULL),
absorbed AS (
  SELECT DISTINCT k.id, c.term AS alias FROM cards c JOIN kept k ON k.canonical_term = c.target
  WHERE c.target <> c.canonical_term)"""

# Greedy packing one paragraph at a time, all documents in step.
CHUNKS_SQL = f"""{MD_SQL}, RECURSIVE_paras AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, length(p) // 2 AS cost
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE {strip_sql('p')} <> ''),
large AS (SELECT doc_id FROM documents WHERE length(replace(text, chr(10), '  ')) // 2 > 500),
walk AS (
  SELECT r.doc_id, r.n, 0 AS piece, r.cost AS size FROM RECURSIVE_paras r JOIN large USING (doc_id)
  WHERE n = 1
  UNION ALL
  SELECT w.doc_id, r.n, CASE WHEN w.size + r.cost > 450 THEN w.piece + 1 ELSE w.piece END,
         CASE WHEN w.size + r.cost > 450 THEN r.cost ELSE w.size + r.cost END
  FROM walk w JOIN RECURSIVE_paras r ON r.doc_id = w.doc_id AND r.n = w.n + 1),
raw_chunks AS (
  SELECT doc_id, piece, string_agg(p, chr(10) || chr(10) ORDER BY n) AS chunk
  FROM walk JOIN RECURSIVE_paras USING (doc_id, n) GROUP BY doc_id, piece
  UNION ALL
  SELECT doc_id, 0, replace(text, chr(10), chr(10) || chr(10)) FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM large)),
chunks AS (
  SELECT doc_id, piece, (length(chunk) // 2)::INT AS n_tokens,
         '[' || title || '] > (서두)'
           || CASE WHEN count(*) OVER d > 1 THEN ' (' || (piece + 1) || '/' || count(*) OVER d || ')'
                   ELSE '' END AS context_header,
         {strip_sql('chunk')} AS text, source
  FROM raw_chunks JOIN md USING (doc_id) WINDOW d AS (PARTITION BY doc_id))"""
CHUNKS_SQL = CHUNKS_SQL.replace("RECURSIVE_paras", "paras")

def blocks_sql(figures: int) -> str:
    """Blocks of the article element by splitting at the tags; ``figures`` counts bold openings."""
    text = "regexp_replace(part, '(?s)</(p|h1)>.*$', '')"
    text = f"regexp_replace(regexp_replace({text}, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
    text = f"replace(replace({text}, '&quot;', '\"'), '&amp;', '&')"
    text = strip_sql(f"regexp_replace(nfc_normalize({text}), '\\s+', ' ', 'g')")
    return f"""articles AS (
  SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
parts AS (
  SELECT page_id, unnest(string_split_regex(body, '<(p|h1)>')) AS part,
         unnest(list_prepend('', regexp_extract_all(body, '<(p|h1)>', 1))) AS tag,
         generate_subscripts(string_split_regex(body, '<(p|h1)>'), 1) AS n FROM articles),
texts AS (
  SELECT page_id, n, tag, CASE WHEN tag = '' THEN '' ELSE {text} END AS text,
         {figures} * len(regexp_extract_all(part, '<b>')) AS figures FROM parts),
blocks AS (
  SELECT *, (sum(figures + (text <> '')::INT) OVER w - (text <> '')::INT - figures)::INT AS before,
         sum((tag = 'h1' AND text <> '')::INT) OVER w::INT AS through
  FROM texts WINDOW w AS (PARTITION BY page_id ORDER BY n))"""


SPANS_SQL = f"""spans AS (
  SELECT *, {strip_sql('text')} AS clean FROM (
    SELECT doc_id, n, length(line) < 40 AS bold,
           CASE WHEN length(line) < 40 THEN regexp_replace(line, '\\.$', ':') ELSE line END AS text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))),
marked AS (
  SELECT *, bold AND clean LIKE '%:' AS closes_term, NOT bold OR clean LIKE '%:' AS closes
  FROM spans WHERE clean <> '' AND NOT regexp_matches(clean, '^(#|___)')),
numbered AS (
  SELECT *, sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY n) - closes::INT AS unit FROM marked),
units AS (
  SELECT doc_id, unit, bool_or(closes_term) AS is_term,
         string_agg(CASE WHEN bold THEN clean ELSE text END, ' ' ORDER BY n) AS piece,
         max(clean) FILTER (closes) AS last
  FROM numbered GROUP BY ALL HAVING bool_or(closes)),
opened AS (
  SELECT *, is_term AND (piece NOT LIKE '(%' OR unit = min(unit) FILTER (is_term)
                                                 OVER (PARTITION BY doc_id)) AS opens FROM units),
entered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY unit) AS entry FROM opened),
entries AS (
  SELECT doc_id, entry::BIGINT AS entry,
         max({strip_sql("regexp_replace(piece, ':+$', '')")}) FILTER (opens) AS term,
         coalesce(string_agg(CASE WHEN is_term THEN last ELSE piece END, ' ' ORDER BY unit)
                  FILTER (NOT opens), '') AS text
  FROM entered WHERE entry > 0 GROUP BY ALL)"""

CAPTION_LIST_SQL = """figures AS (
  SELECT doc_id, quality + toxic AS section, 'figure ' || quality AS caption, 1 AS n
  FROM labels WHERE toxic = 0
  UNION ALL SELECT doc_id, 99, 'closing figure', 2 FROM labels)"""


def placed_sql(key: str) -> str:
    """Sections with the captions whose heading number they are the last to reach."""
    return f"""placed AS (
  SELECT f.{key}, coalesce(max(s.ordinal) FILTER (s.ordinal <= f.section), min(s.ordinal)) AS ordinal,
         f.n, any_value(f.caption) AS caption
  FROM figures f JOIN sections s USING ({key}) GROUP BY f.{key}, f.section, f.n),
captioned AS (
  SELECT s.{key}, s.ordinal, s.heading,
         s.text || coalesce((SELECT string_agg(chr(10) || chr(10) || '[그림 설명: ' || caption || ']', ''
                                               ORDER BY n)
                             FROM placed p WHERE p.{key} = s.{key} AND p.ordinal = s.ordinal), '') AS text
  FROM sections s)"""


BUILT_SQL = f"""{MD_SQL}, {sections_sql('md', 'doc_id')}, {CAPTION_LIST_SQL}, {placed_sql('doc_id')},
counted AS (
  SELECT m.doc_id, (SELECT count(*) FROM grouped g WHERE g.doc_id = m.doc_id AND g.ordinal > 0) AS heads
  FROM md m),
internal AS (
  SELECT 'item-' || item_id AS slug, 'Item ' || item_id AS title, text AS raw FROM benchmark),
internal_sections AS (
  SELECT slug, CASE WHEN n > 1 THEN 'Part' END AS heading, {strip_sql('line')} AS text, n - 1 AS ordinal
  FROM (SELECT slug, unnest(string_split(raw, chr(10))) AS line,
               generate_subscripts(string_split(raw, chr(10)), 1) AS n FROM internal)
  WHERE {strip_sql('line')} <> ''),
built AS (
  SELECT m.source || '-' || m.slug AS doc_id, m.source, m.url, m.title,
         CASE m.lang WHEN 'en' THEN 'EN 시리즈' WHEN 'de' THEN m.source END AS series,
         CASE WHEN m.lang = 'en' THEN n_chars::INT END AS part, m.lang AS language, m.doc_type,
         (SELECT count(*) FROM captioned c WHERE c.doc_id = m.doc_id)::INT AS n_sections,
         (SELECT count(*) FROM figures f WHERE f.doc_id = m.doc_id)::INT AS n_captions,
         md5((SELECT string_agg(CASE WHEN heading IS NULL THEN text ELSE heading || '|' || text END,
                                '||' ORDER BY ordinal) FROM captioned c WHERE c.doc_id = m.doc_id))
           AS content_md5
  FROM md m JOIN documents d USING (doc_id) JOIN counted k USING (doc_id)
  WHERE NOT (m.doc_type = 'article' AND length(body) < 500)
    AND NOT (m.doc_type = 'glossary' AND heads = 0)
  UNION ALL
  SELECT 'internal-' || slug, 'internal_docs', NULL, any_value(title), NULL, NULL, 'ko', 'article',
         count(*)::INT, 0,
         md5(string_agg(CASE WHEN heading IS NULL THEN text ELSE heading || '|' || text END, '||'
                        ORDER BY ordinal))
  FROM internal JOIN internal_sections USING (slug) GROUP BY slug)"""

CLEAN_SQL = f"""{blocks_sql(0)},
bodies AS (
  SELECT page_id, string_agg(CASE tag WHEN 'h1' THEN chr(10) || '## ' ELSE '' END || text || chr(10), chr(10)
                             ORDER BY before) AS body FROM blocks WHERE text <> '' GROUP BY page_id),
clean AS (
  SELECT page_id, 'article' AS doc_type,
         {strip_sql("regexp_replace(nfc_normalize(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', chr(34)), '&amp;', '&')), '[[:space:]]+', ' ', 'g')")} AS title,
         {strip_sql("regexp_replace(coalesce(body, ''), '[[:cntrl:]]{{3,}}', chr(10) || chr(10), 'g')")} AS body,
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '//(m|blog)\\.', '//') AS url,
         regexp_extract(url, '//([^/]+)/', 1) AS source
  FROM pages LEFT JOIN bodies USING (page_id))"""

TERM_SQL = "regexp_matches(lower(caption), '(^|[^a-z])(the|und|que|los)([^a-z]|$)')"

FOOTNOTES_SQL = rf"""notes AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^※\s*(.+?)\s*[:：]\s*(.+)$', 1)) AS raw,
         unnest(regexp_extract_all(t, '(?m)^※\s*(.+?)\s*[:：]\s*(.+)$', 2)) AS def
  FROM (SELECT doc_id, '※ ' || replace(replace(text, ',', ':'), chr(10), chr(10) || '※ ') AS t
        FROM documents)),
bracketed AS (
  SELECT *, regexp_matches(raw, '^.*?\S\s*[（(][^）)]+[）)]\s*$') AS has_alias FROM notes),
named AS (
  SELECT *, CASE WHEN has_alias THEN {strip_sql(r"regexp_extract(raw, '^(.*?)\s*[（(]([^）)]+)[）)]\s*$', 1)")}
                 ELSE {strip_sql('raw')} END AS term,
         CASE WHEN has_alias THEN string_split(replace(
           regexp_extract(raw, '^(.*?)\s*[（(]([^）)]+)[）)]\s*$', 2), '/', ','), ',') ELSE [] END AS aliases
  FROM bracketed)"""

ORACLES = {
    "clean_documents": f"WITH {CLEAN_SQL} SELECT * FROM clean",
    "clean_gate": f"""WITH {CLEAN_SQL}, counted AS (
  SELECT *, length(body)::INT AS chars,
         len(regexp_extract_all(chr(10) || body, '\\n## [^\\n]'))::INT AS n FROM clean)
SELECT page_id AS doc_id, source, chars, n AS sections, chars >= 500 AS include,
  CASE WHEN chars < 500 THEN 'too_short' WHEN n = 0 THEN 'no_sections' END AS reason FROM counted""",
    "clean_sections": f"""WITH {CLEAN_SQL}, docs AS (SELECT *, page_id AS doc_id FROM clean),
{sections_sql('docs', 'doc_id')}
SELECT doc_id, ordinal, heading, md5(text) AS text_md5 FROM sections""",
    "page_blocks": f"""WITH {blocks_sql(0)}
SELECT page_id, before AS pos, through AS section,
  CASE tag WHEN 'h1' THEN 'heading' ELSE 'paragraph' END AS kind, text FROM blocks WHERE text <> ''""",
    "page_images": f"""WITH {blocks_sql(1)}
SELECT page_id, before + f AS pos, through - (tag = 'h1' AND text <> '')::INT AS section,
  '/fig.png' AS src, 'figure' AS alt
FROM blocks, LATERAL (SELECT unnest(range(figures))::INT AS f)""",
    "glossary_from_spans": f"""WITH {SPANS_SQL}, clean AS (
  SELECT doc_id, entry, {NORMALIZED} AS definition, {NORMALIZED.replace('(text)', '(term)')} AS term
  FROM entries)
SELECT * FROM clean WHERE length(definition) >= 10""",
    "read_corpus_jsonl": """SELECT 'chunk-' || doc_id AS id, doc_id::VARCHAR AS doc_id,
  md5(text) AS text_md5, source, NULL::VARCHAR AS series, lang AS language,
  (n_chars // 2)::INT AS n_tokens FROM documents""",
    "read_clean_docs": f"""SELECT doc_id, nullif({strip_sql(FIRST)}, '') AS title, source,
  NULL::VARCHAR AS url, lang AS language, 4 AS n_meta, md5(text) AS body_md5 FROM documents""",
    "manifest_upsert": f"WITH {MANIFEST_SQL} SELECT * FROM manifest",
    "stored_manifest_upsert": f"WITH {MANIFEST_SQL} SELECT * FROM manifest",
    "manifest_status_summary": f"""WITH {MANIFEST_SQL}
SELECT status, count(*) AS n FROM manifest GROUP BY status""",
    "keyword_select": """SELECT p_partkey AS id, p_name AS title,
  CASE WHEN regexp_matches(p_name, '(?i)red|hot') THEN 'excluded_keyword'
       WHEN NOT regexp_matches(p_name, '(?i)ring|widget|plate') THEN 'no_keyword' END AS reason,
  CASE WHEN regexp_matches(p_name, '(?i)ring|widget|plate')
        AND NOT regexp_matches(p_name, '(?i)red|hot') THEN 'selected'
       ELSE 'candidate_skipped' END AS status FROM part""",
    "term_keyword_filter": f"""WITH {LINES_SQL}
SELECT doc_id, section AS line, caption AS term FROM lines WHERE {TERM_SQL}""",
    "term_filter_totals": f"""WITH {LINES_SQL}
SELECT count(*) AS found, count(*) FILTER ({TERM_SQL}) AS kept FROM lines""",
    "listing_dedupe": f"""WITH {PAGE_SQL}
SELECT url, tag, 1 AS page, page_id AS pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY tag, page_id) AS rn FROM listing)
WHERE rn = 1 AND url NOT IN (SELECT url FROM listing WHERE contains(title, '%%%'))""",
    "replace_by_source": f"""WITH fresh AS (
  SELECT item_id, 'src' || (length(text) % 3) AS source, {FIRST} AS title, text FROM benchmark),
kept AS (SELECT doc_id + 1 AS n, source, {FIRST} AS title, text FROM documents
         WHERE source NOT IN (SELECT source FROM fresh)),
numbered AS (
  SELECT n, source, title, text FROM kept
  UNION ALL
  SELECT (SELECT max(n) FROM kept) + row_number() OVER (ORDER BY source, item_id), source, title, text
  FROM fresh)
SELECT 'd' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id,
       source, title, md5(text) AS text_md5 FROM numbered""",
    "corpus_titles": f"""SELECT 'd' || CASE WHEN doc_id < 999 THEN lpad((doc_id + 1)::VARCHAR, 3, '0')
  ELSE (doc_id + 1)::VARCHAR END || chr(9) || source || chr(9) || {FIRST} AS line FROM documents""",
    "caption_risk_class": f"""WITH {CAPTIONS_SQL}
SELECT src, slug, section, category, CASE category WHEN 'flow' THEN 1 WHEN 'structure' THEN 2
  WHEN 'suspect' THEN 3 ELSE 4 END AS priority FROM classed""",
    "caption_status_summary": f"""WITH {CAPTIONS_SQL}
SELECT 'status' AS kind, CASE WHEN starts_with(status, 'error') THEN 'api_failed' ELSE status END
  AS name, count(*) AS n FROM captions GROUP BY ALL
UNION ALL SELECT 'class', category, count(*) FROM classed GROUP BY ALL""",
    "apply_exclusions": f"""WITH {CAPTIONS_SQL}
SELECT src, slug, section,
  CASE WHEN status = 'ok' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  THEN 'excluded_manual' ELSE status END AS status FROM captions""",
    "exclusion_report": f"""WITH {CAPTIONS_SQL}, toxic AS (
  SELECT * FROM captions WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'changed' AS name, count(*) FILTER (status = 'ok') AS n FROM toxic
UNION ALL SELECT 'requested', count(DISTINCT src) FROM toxic""",
    "normalize_text": f"""SELECT doc_id, length(t)::INT AS chars, md5(t) AS text_md5
FROM (SELECT doc_id, {NORMALIZED} AS t FROM documents)""",
    "block_dedupe": """SELECT page_id, text, pos::INT AS pos FROM (
  SELECT page_id, text, pos, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS rn
  FROM (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))
WHERE rn = 1""",
    "glossary_pairs": f"""WITH {MD_SQL}, {sections_sql('md', 'doc_id')}
SELECT doc_id AS page_id, ordinal AS section, heading AS term, md5(text) AS definition
FROM sections WHERE heading IS NOT NULL""",
    "doc_quality_gate": f"""WITH {MD_SQL}, {sections_sql('md', 'doc_id')}, counted AS (
  SELECT m.*, length(body)::INT AS chars,
         (SELECT count(*) FROM grouped g WHERE g.doc_id = m.doc_id AND g.ordinal > 0)::INT AS n FROM md m)
SELECT doc_id, source, chars, n AS sections,
  NOT (doc_type = 'article' AND chars < 500 OR doc_type = 'glossary' AND n = 0) AS include,
  CASE WHEN doc_type = 'article' AND chars < 500 THEN 'too_short'
       WHEN doc_type = 'glossary' AND n = 0 THEN 'no_terms'
       WHEN doc_type = 'article' AND n = 0 THEN 'no_sections' END AS reason FROM counted""",
    "split_sections": f"""WITH {MD_SQL}, {sections_sql('md', 'doc_id')}
SELECT doc_id, ordinal, heading, md5(text) AS text_md5 FROM sections""",
    "md_header_sections": f"""WITH {MD_SQL}, {sections_sql('md', 'doc_id')}
SELECT doc_id, heading AS title, md5(replace(text, '**', '')) AS text_md5
FROM sections WHERE heading IS NOT NULL""",
    "parse_series": f"""WITH {MD_SQL}
SELECT doc_id, title, CASE lang WHEN 'en' THEN 'EN 시리즈' WHEN 'de' THEN source END AS series,
  CASE WHEN lang = 'en' THEN n_chars::INT END AS part FROM md JOIN documents USING (doc_id, source, lang)""",
    "merge_captions": f"""WITH {MD_SQL}, {sections_sql('md', 'doc_id')}, {CAPTION_LIST_SQL},
{placed_sql('doc_id')}
SELECT doc_id, (SELECT count(*) FROM figures f WHERE f.doc_id = c.doc_id)::INT AS n_captions,
       ordinal, md5(text) AS text_md5 FROM captioned c""",
    "build_documents": f"""WITH {BUILT_SQL}
SELECT doc_id, source, url, title, series, part, language, doc_type, n_captions, content_md5 FROM built""",
    "doc_index": f"""WITH {BUILT_SQL}
SELECT doc_id, source, doc_type, title, n_sections, n_captions FROM built""",
    "term_aliases": """SELECT p_partkey, p_name AS term,
  CASE WHEN p_size <= 30 THEN p_brand || '|' || p_type ELSE p_type END AS aliases FROM part""",
    "split_senses": f"""WITH {GLOSSARY_SQL}, {senses_sql("base || ' (' || lang || ', ' || source || ')'")}
SELECT doc_id, sense, md5(sense_text) AS text_md5 FROM senses""",
    "cards_from_glossary": f"""WITH {GLOSSARY_SQL}, {senses_sql('base')}
SELECT lower({strip_sql(r"regexp_replace(base, '\s+', ' ', 'g')")}) AS canonical_term,
  {strip_sql('base')} AS term, lang || '|' || source AS aliases, md5(sense_text) AS definition_md5, source,
  doc_id AS source_doc, sense FROM senses WHERE source IN ('src1', 'src2')
UNION ALL
SELECT lower({strip_sql(r"regexp_replace(base, '\s+', ' ', 'g')")}), {strip_sql('base')},
  lang || '|' || source, md5({strip_sql('text')}), source, doc_id, 0
FROM glossary WHERE source NOT IN ('src1', 'src2')""",
    "cards_from_footnotes": rf"""WITH {FOOTNOTES_SQL}
SELECT doc_id AS source_doc, lower({strip_sql(r"regexp_replace(term, '\s+', ' ', 'g')")}) AS canonical_term,
  term, md5({strip_sql('def')}) AS definition_md5 FROM named""",
    "resolve_see_refs": f"""WITH {CARDS_SQL}
SELECT 'card' AS kind, canonical_term, term AS value, id FROM cards WHERE target IS NULL
UNION ALL
SELECT DISTINCT 'alias', target, term, NULL FROM cards
WHERE target <> canonical_term AND target IN (SELECT canonical_term FROM cards)""",
    "see_embedding_text": f"""WITH {CARDS_SQL}, {ABSORBED_SQL}, listed AS (
  SELECT id, count(alias) AS n, string_agg(alias, ', ' ORDER BY alias) AS names
  FROM absorbed GROUP BY id)
SELECT k.id, (2 + coalesce(n, 0))::INT AS n_aliases,
  md5(term || ' (' || p_brand || ', ' || p_type || coalesce(', ' || names, '') || '): ' || definition) AS text
FROM kept k LEFT JOIN listed USING (id)""",
    "see_term_index": f"""WITH {CARDS_SQL}, {ABSORBED_SQL}
SELECT lower(name) AS key, id FROM (
  SELECT id, unnest([term, p_brand, p_type]) AS name FROM kept
  UNION ALL SELECT id, alias FROM absorbed)""",
    "see_report": f"""WITH {CARDS_SQL}
SELECT CASE WHEN target IS NULL THEN 'kept'
            WHEN target <> canonical_term AND target IN (SELECT canonical_term FROM cards)
            THEN 'absorbed' ELSE 'dropped' END AS state, count(*) AS n FROM cards GROUP BY 1""",
    "chunk_sections": f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, piece, n_tokens, context_header, md5(text) AS text_md5 FROM chunks""",
    "assign_corpus_ids": f"""WITH RECURSIVE {CHUNKS_SQL}, numbered AS (
  SELECT doc_id, piece, row_number() OVER (ORDER BY doc_id || '.json', piece) AS n FROM chunks)
SELECT 'chunk-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id,
  doc_id, piece FROM numbered""",
    "corpus_stats": f"""WITH RECURSIVE {CHUNKS_SQL}, {CARDS_SQL}
SELECT 'cards' AS metric, '' AS name, count(*)::DOUBLE AS value FROM cards
UNION ALL SELECT 'cards_by_source', source, count(*) FROM cards GROUP BY source
UNION ALL SELECT 'cards_by_extracted_by', extracted_by, count(*) FROM cards GROUP BY extracted_by
UNION ALL SELECT 'chunks', '', count(*) FROM chunks
UNION ALL SELECT 'chunks_by_source', source, count(*) FROM chunks GROUP BY source
UNION ALL SELECT 'duplicate_terms', '', count(*) FROM (
  SELECT canonical_term FROM cards GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'chunk_tokens', 'min', min(n_tokens) FROM chunks
UNION ALL SELECT 'chunk_tokens', 'max', max(n_tokens) FROM chunks
UNION ALL SELECT 'chunk_tokens', 'mean', round(avg(n_tokens), 1) FROM chunks
UNION ALL SELECT 'chunks', 'caption_only', count(*) FROM chunks WHERE length({strip_sql('text')}) < 15""",
    "embedding_text": f"""WITH {MD_SQL}
SELECT 'card-' || p_partkey AS id, 'glossary' AS kind,
  md5(p_name || ' ' || p_brand || ' (' || p_brand || ', ' || p_type || '): '
      || CASE WHEN p_size <= 10 THEN 'See "' || upper(p_name) || ' Brand#1".'
              ELSE p_type || ' ' || p_size END) AS text FROM part
UNION ALL SELECT 'chunk-' || doc_id, 'article', md5(title || chr(10) || body) FROM md""",
}
