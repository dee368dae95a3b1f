"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexgraft.llm import audit, brown, chat, decontaminate, lines, mixing, quality, ring, secrets, simhash, spelling, topk, toxicity

MODULES = (toxicity, quality, mixing, lines, brown, decontaminate, topk, simhash, secrets, chat, spelling, audit, ring)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
