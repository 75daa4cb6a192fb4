"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: Modules that define QUERIES and ORACLES.
MODULES = ("queries_text", "queries_vectors", "queries_models", "queries_corpus")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
