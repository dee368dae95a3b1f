"""Queries of the library by name, with their SQL for DuckDB where it can express them."""

from __future__ import annotations

from lexgraft.plans import apply, filed, lookups, rounds, rules, texts
from lexgraft.sources import tables

MODULES = (texts, lookups, rules, apply, rounds, filed)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Each text may use the derived tables of sources.tables, and starts with CTEs of its own or with SELECT."""
    out = {}
    for m in MODULES:
        for name, text in m.SQL.items():
            text = text.strip()
            own = text[4:].strip() if text.upper().startswith("WITH") else None
            out[name] = f"WITH RECURSIVE {tables.SQL.strip()}, {own}" if own else f"WITH RECURSIVE {tables.SQL.strip()} {text}"
    return out
