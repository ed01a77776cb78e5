"""The registered queries over the given tables, with their SQL."""

from __future__ import annotations

from quillgrid.plans import queries_documents, queries_enrich, queries_relational, queries_rollups, queries_search, queries_sources, queries_streaming, queries_tables, queries_text  # noqa: F401
from quillgrid.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
