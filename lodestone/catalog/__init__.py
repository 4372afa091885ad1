"""Registered queries and their SQL counterparts over the driver tables."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from lodestone.session import prepare

MODULES = (
    "text_queries",
    "chunk_queries",
    "index_queries",
    "retrieval_queries",
    "answer_queries",
    "cost_queries",
    "audit_queries",
    "file_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"lodestone.catalog.{name}"), attribute))
    return merged


def _shipping(query):
    @wraps(query)
    def run(spark, folder):
        prepare(spark)
        return query(spark, folder)

    return run


def queries() -> dict:
    return {name: _shipping(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
