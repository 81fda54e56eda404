"""All queries of the engine and their SQL."""

from __future__ import annotations

from fathom.plans import chunking, extras, reasoning, search, transform

MODULES = [chunking, search, reasoning, extras, transform]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
