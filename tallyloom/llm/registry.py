"""The queries of this subpackage, by name, with their SQL where there is one."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name: function of session and folder) and SQL (name: text).
MODULES = ("queries_dedup", "queries_text", "queries_mixing", "queries_learning", "queries_vectors", "queries_packing")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").SQL
    return out
