"""Registry of all queries with their SQL equivalents."""

from __future__ import annotations

from strandline.plans import extraction, grammar, records, retrieval, views

_MODULES = [retrieval, records, grammar, views, extraction]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark, sf_dir: str):
    """Lexical, dense and label legs fused by intent-weighted reciprocal ranks."""
    return retrieval.rrf_intent_weighted(spark, sf_dir)
