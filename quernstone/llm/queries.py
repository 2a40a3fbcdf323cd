"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ["toxicity", "quality_rules", "quality_model", "language_model", "mixing", "decontaminate", "substring", "simhash", "urls", "warc"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), "ORACLE_SQL", {})
    return found
