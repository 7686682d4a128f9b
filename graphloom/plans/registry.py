"""Registered queries and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
MODULES = ["scans", "texts", "graphs", "aggregates", "retrievals", "streams", "pipelines"]


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with SQL that gives the same rows where SQL can."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark, sf_dir):
    """Inference over the whole fixture graph."""
    _load()
    return QUERIES["g9_inference"](spark, sf_dir)
