"""All registered analyses by name."""

from __future__ import annotations

from yieldloom.plans import (
    corpus_queries,
    evaluation_queries,
    retrieval_queries,
    yield_queries,
)

_PARTS = (yield_queries, corpus_queries, retrieval_queries, evaluation_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
