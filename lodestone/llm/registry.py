"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

from lodestone.llm.tables import shipped

MODULES = ("lines", "substrings", "minhash", "decontaminate", "encoded", "pii", "language", "simhash", "pages", "bpe", "whitening", "chat", "spelling")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"lodestone.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    return {name: shipped(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
