"""All queries of the core, by name."""

from __future__ import annotations

from lonja.plans import data_problems, lake_queries, sales_queries

MODULES = [sales_queries, lake_queries, data_problems]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
