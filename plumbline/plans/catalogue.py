"""The queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from . import q_build, q_more, q_rows, q_scores, q_search, q_shape, q_store  # noqa: F401 (they register their queries)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
