"""Registered retrieval analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.operators import corpus, retrieval
from yieldloom.operators.ranking import top_per_group
from yieldloom.plans.corpus_queries import FOOTNOTES_SQL
from yieldloom.sources import tables
from yieldloom.sources.scratch import scratch_path

TOP_N = 10
RESULTS = 3


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the cards that the lines of whole texts define, under their document."""
    cards = corpus.cards_from_footnotes(tables.footnote_docs(spark, folder))
    return retrieval.term_index(cards.select(F.col("source_doc").alias("id"), "term", "aliases"))


def term_index(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).select("key", "id")


def exact_term_match(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.exact_term_match(_index(spark, folder), tables.user_questions(spark, folder))


def _exact_for_items(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.exact_term_match(_index(spark, folder), tables.text_queries(spark, folder))


def _topk(spark: SparkSession, folder: str, k: int = TOP_N) -> DataFrame:
    return retrieval.vector_topk(
        tables.vector_records(spark, folder), tables.vector_queries(spark, folder), k
    )


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _topk(spark, folder)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.merge_by_distance(
        _exact_for_items(spark, folder), _topk(spark, folder, RESULTS), RESULTS
    )


def merge_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


def format_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.format_context(
        tables.text_queries(spark, folder),
        _merged(spark, folder),
        tables.record_texts(spark, folder),
    )
    return rows.withColumn("context", F.md5("context"))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.tokenize(tables.text_records(spark, folder))
    return rows.select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


def bm25_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.bm25_index(tables.text_records(spark, folder))
    return rows.withColumn("idf", F.round("idf", 6))


def _keyword(spark: SparkSession, folder: str, n: int = TOP_N) -> DataFrame:
    return retrieval.bm25_topk(
        tables.text_records(spark, folder), tables.text_queries(spark, folder), n
    )


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _keyword(spark, folder)


def keyword_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same search through a keyword index that is written by term and read back."""
    path = scratch_path(spark, "keyword-index")
    retrieval.build_index(tables.text_records(spark, folder), path)
    return retrieval.search_index(spark, path, tables.text_queries(spark, folder), TOP_N)


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    pool = schemas.HYBRID_POOL
    vector = retrieval.vector_ranking(_topk(spark, folder, pool))
    keyword = _keyword(spark, folder, pool)
    return retrieval.rrf_fuse(
        retrieval.as_rank_list(vector, "vector").unionByName(
            retrieval.as_rank_list(keyword, "bm25")
        )
    )


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder)


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """The relevant record of an item is the first other record with its label."""
    firsts = top_per_group(
        tables.vector_records(spark, folder).select("label", F.col("id").alias("source_id")),
        ["label"],
        ["source_id"],
        2,
        "_n",
    ).drop("_n")
    return (
        tables.vector_queries(spark, folder)
        .join(firsts, "label")
        .filter(F.col("source_id") != F.col("query_id"))
        .groupBy("query_id", "text", "label")
        .agg(F.min("source_id").alias("source_id"))
        .select(
            "query_id",
            "source_id",
            F.when(F.col("text").contains("\n"), "casual").otherwise("formal").alias("phrasing"),
            F.when(F.col("label") < 5, "glossary_card").otherwise("article_chunk").alias("source_type"),
            F.concat(F.lit("label-"), "label").alias("question_type"),
        )
    )


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    vector = retrieval.vector_ranking(_topk(spark, folder))
    ranked = retrieval.retrieval_rank(_expected(spark, folder), vector, "vector_rank")
    return retrieval.retrieval_rank(ranked, _fused(spark, folder), "hybrid_rank")


def retrieval_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder).select("query_id", "source_id", "vector_rank", "hybrid_rank")


BREAKDOWNS = ["phrasing", "source_type", "question_type"]


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    vector = retrieval.vector_ranking(_topk(spark, folder))
    ranked = retrieval.retrieval_rank(_expected(spark, folder), vector, "vector_rank")
    return retrieval.retrieval_metrics(ranked, "vector_rank", BREAKDOWNS)


def hybrid_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The same figures for the fused list of vector and keyword search."""
    ranked = retrieval.retrieval_rank(_expected(spark, folder), _fused(spark, folder), "hybrid_rank")
    return retrieval.retrieval_metrics(ranked, "hybrid_rank", BREAKDOWNS)


def doc_cited(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of the question occur in a line of its best keyword records?

    Lines are the section titles of a record. Each question has at most ``TOP_N`` records.
    """
    titles = (
        _keyword(spark, folder)
        .join(tables.record_texts(spark, folder).select("id", F.split("content", "\n").alias("lines")), "id")
        .groupBy("query_id")
        .agg(F.flatten(F.collect_list("lines")).alias("titles"))
    )
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    cases = (
        tables.text_queries(spark, folder)
        .join(titles, "query_id", "left")
        .select("query_id", "titles", F.explode_outer(words).alias("word"))
        .select("query_id", "titles", F.concat(F.lit("Guide > "), "word").alias("related_doc"))
    )
    return retrieval.doc_cited(cases).select("query_id", "related_doc", "cited")


QUERIES = {
    f.__name__: f
    for f in (
        term_index,
        exact_term_match,
        vector_topk,
        merge_by_distance,
        format_context,
        tokenize,
        bm25_index,
        bm25_topk,
        keyword_index,
        rrf_fuse,
        retrieval_rank,
        retrieval_metrics,
        hybrid_metrics,
        doc_cited,
    )
}

CANON = r"lower(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"

INDEX_SQL = f"""{FOOTNOTES_SQL},
names AS (
  SELECT doc_id AS id, term AS name, 0 AS pos FROM named
  UNION ALL SELECT doc_id, unnest(aliases), generate_subscripts(aliases, 1) FROM named),
idx AS (
  SELECT key, id, pos FROM (SELECT {CANON.format('name')} AS key, id, pos FROM names)
  WHERE length(key) >= 2)"""


def exact_sql(queries: str) -> str:
    return f"""{INDEX_SQL}, q AS MATERIALIZED (
  SELECT query_id, {CANON.format('text')} AS text FROM ({queries})),
firsts AS (SELECT key, min((id, pos)) AS first FROM idx GROUP BY key),
hits AS (
  SELECT q.query_id, i.id AS card_id, min((-length(f.key), f.first)) AS place
  FROM q JOIN firsts f ON contains(q.text, f.key) JOIN idx i ON i.key = f.key
  GROUP BY ALL),
exact AS (
  SELECT query_id, card_id, rank, -place[1] AS key_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, card_id) AS rank FROM hits)
  WHERE rank <= 2)"""


ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def topk_sql(k: int) -> str:
    return f"""near AS (
  SELECT b.item_id AS query_id, r.vec_id AS id,
         CASE WHEN r.label < 5 THEN 'glossary' ELSE 'article' END AS kind,
         abs(round(1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6))
           AS distance
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings r),
topk AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY distance, id)
                 AS kind_rank FROM near) WHERE kind_rank <= {k}),
vector_list AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM topk)"""


TOKENS_SQL = """toks AS (
  SELECT doc_id AS id, regexp_extract_all(lower(text), '[0-9A-Za-z_]+|[가-힣]+') AS t FROM documents),
postings AS (
  SELECT id, len(t) AS dl, term, count(*) AS tf
  FROM (SELECT id, t, unnest(t) AS term FROM toks) GROUP BY ALL),
totals AS (SELECT count(*) AS n, avg(len(t)) AS mean_dl FROM toks),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf,
         ln((SELECT n FROM totals) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw
  FROM postings GROUP BY term),
idfs AS (
  SELECT term, df, total_tf,
         CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM vocab) ELSE raw END AS idf FROM vocab)"""


def keyword_sql(n: int) -> str:
    return f"""{TOKENS_SQL}, qterms AS (
  SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+|[가-힣]+')) AS term
  FROM benchmark),
keyword_list AS (
  SELECT * FROM (
    SELECT query_id, id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT query_id, id, round(sum(idf * tf * 2.5e0
                   / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (SELECT mean_dl FROM totals)))), 6) AS score
          FROM qterms JOIN idfs USING (term) JOIN postings USING (term) GROUP BY ALL)
    WHERE score > 0) WHERE rank <= {n})"""


FUSED_SQL = """fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, id)
    AS rank
  FROM (SELECT query_id, id, round(sum(1e0 / (60 + rank)), 12) AS score,
               min(rank) FILTER (l = 'vector') AS vector_rank
        FROM (SELECT query_id, id, rank, 'vector' AS l FROM vector_list
              UNION ALL SELECT query_id, id, rank, 'bm25' FROM keyword_list) GROUP BY ALL))"""

EXPECTED_SQL = """expected AS (
  SELECT b.item_id AS query_id, b.text, q.label,
         (SELECT min(vec_id) FROM embeddings e WHERE e.label = q.label AND e.vec_id <> b.item_id)
           AS source_id
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id)"""

MERGED_SQL = f"""merged AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY level, place) AS position, id,
         kind, distance
  FROM (SELECT query_id, card_id AS id, 'glossary_exact' AS kind, 0e0 AS distance, 0 AS level,
               rank AS place FROM exact
        UNION ALL
        SELECT * FROM (
          SELECT query_id, id, kind, distance, 1,
                 row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place
          FROM topk WHERE (query_id, id) NOT IN (SELECT (query_id, card_id) FROM exact))
        WHERE place <= {RESULTS}))"""

def metrics_sql(found: str) -> str:
    return f"""ranked AS (
  SELECT CASE WHEN contains(text, chr(10)) THEN 'casual' ELSE 'formal' END AS phrasing,
         CASE WHEN label < 5 THEN 'glossary_card' ELSE 'article_chunk' END AS source_type,
         'label-' || label AS question_type, v.rank
  FROM expected e LEFT JOIN {found} v ON v.query_id = e.query_id AND v.id = source_id),
long AS (
  SELECT 'overall' AS dimension, '' AS value, rank FROM ranked
  UNION ALL SELECT 'phrasing', phrasing, rank FROM ranked
  UNION ALL SELECT 'source_type', source_type, rank FROM ranked
  UNION ALL SELECT 'question_type', question_type, rank FROM ranked)
SELECT dimension, value, count(*) AS n,
  round(count(*) FILTER (rank <= 1) * 1e0 / count(*), 4) AS accuracy_1,
  round(count(*) FILTER (rank <= 3) * 1e0 / count(*), 4) AS accuracy_3,
  round(count(*) FILTER (rank <= 5) * 1e0 / count(*), 4) AS accuracy_5,
  round(avg(CASE WHEN rank <= 10 THEN 1e0 / log2(rank + 1) ELSE 0e0 END), 4) AS ndcg_10
FROM long GROUP BY ALL"""


ORACLES = {
    "term_index": f"WITH {INDEX_SQL} SELECT key, id FROM idx",
    "exact_term_match": "WITH " + exact_sql(
        "SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'"
    ) + " SELECT * FROM exact",
    "vector_topk": f"WITH {topk_sql(TOP_N)} SELECT query_id, kind, id, distance, kind_rank FROM topk",
    "merge_by_distance": f"WITH {exact_sql(ITEMS)}, {topk_sql(RESULTS)}, {MERGED_SQL} SELECT * FROM merged",
    "format_context": f"""WITH {exact_sql(ITEMS)}, {topk_sql(RESULTS)}, {MERGED_SQL}, blocks AS (
  SELECT query_id, position,
         '[' || string_split(text, chr(10))[1] || ']'
         || CASE WHEN lang <> 'de' THEN ' (출처: https://docs.example.com/' || lang || '/' || doc_id || ')'
                 ELSE '' END || chr(10) || text AS block
  FROM merged JOIN documents ON doc_id = id)
SELECT item_id AS query_id, count(block)::INT AS n_docs,
  md5(coalesce(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position),
               '{retrieval.EMPTY_CONTEXT}')) AS context
FROM benchmark LEFT JOIN blocks ON query_id = item_id GROUP BY item_id""",
    "tokenize": f"""WITH {TOKENS_SQL}
SELECT id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks""",
    "bm25_index": f"WITH {TOKENS_SQL} SELECT term, df, total_tf, round(idf, 6) AS idf FROM idfs",
    "bm25_topk": f"WITH {keyword_sql(TOP_N)} SELECT * FROM keyword_list",
    "keyword_index": f"WITH {keyword_sql(TOP_N)} SELECT * FROM keyword_list",
    "rrf_fuse": f"""WITH {topk_sql(schemas.HYBRID_POOL)}, {keyword_sql(schemas.HYBRID_POOL)}, {FUSED_SQL}
SELECT query_id, id, score, rank FROM fused""",
    "retrieval_rank": f"""WITH {topk_sql(schemas.HYBRID_POOL)}, {keyword_sql(schemas.HYBRID_POOL)},
{FUSED_SQL}, {EXPECTED_SQL}, vector_10 AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM topk WHERE kind_rank <= {TOP_N})
SELECT e.query_id, source_id, v.rank AS vector_rank, f.rank AS hybrid_rank
FROM expected e LEFT JOIN vector_10 v ON v.query_id = e.query_id AND v.id = source_id
LEFT JOIN fused f ON f.query_id = e.query_id AND f.id = source_id""",
    "retrieval_metrics": f"""WITH {topk_sql(TOP_N)}, {EXPECTED_SQL}, {metrics_sql('vector_list')}""",
    "hybrid_metrics": f"""WITH {topk_sql(schemas.HYBRID_POOL)}, {keyword_sql(schemas.HYBRID_POOL)},
{FUSED_SQL}, {EXPECTED_SQL}, {metrics_sql('fused')}""",
    "doc_cited": f"""WITH {keyword_sql(TOP_N)}, words AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '\\S+')) AS word FROM benchmark),
titles AS (
  SELECT k.query_id, unnest(string_split(d.text, chr(10))) AS title
  FROM keyword_list k JOIN documents d ON d.doc_id = k.id)
SELECT item_id AS query_id, 'Guide > ' || word AS related_doc,
  coalesce(bool_or(contains(title, word)), false) AS cited
FROM words LEFT JOIN titles ON query_id = item_id GROUP BY ALL""",
}
