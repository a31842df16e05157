"""Query registry: ``queries()`` callables ``(spark, sf_dir) -> DataFrame``
and their independent SQL twins (DuckDB dialect, the correctness oracle).

Conventions shared by both sides: every double is rounded to 6 digits,
counts are BIGINT, ids INT, arrays are rendered as comma-joined text, and
the seeded order is ``md5('<seed>:' || key)`` then ``key``.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens on import)."""
    from roundlearn.plans import (q_documents, q_embeddings, q_events, q_io, q_models,  # noqa: F401
                                  q_streaming)
