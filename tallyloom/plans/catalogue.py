"""All catalogue queries and their SQL."""

from __future__ import annotations

from . import decoding, gates, kits, publishing, scores, tables_grid, tables_runs, tables_text

MODULES = (scores, tables_text, tables_grid, tables_runs, decoding, publishing, gates, kits)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
