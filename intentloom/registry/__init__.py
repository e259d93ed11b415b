"""Registered proof queries: a Spark callable and its DuckDB oracle SQL.

Each query reads the given parquet tables at ``sf_dir`` (or data Spark derives
from them) over whole tables.  ``SQL`` strings run in DuckDB against views of
the same tables.  Column names match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    from intentloom.registry import (  # noqa: F401
        q_split, q_labels, q_pairs, q_score, q_eval, q_encode, q_episodes, q_sources, q_vectors, q_models,
        q_sweeps, q_streaming, q_nli, q_datasets)
