"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from lexigrid.plans import core_queries, corpus_queries, lm_queries, translation_queries

MODULES = [core_queries, lm_queries, corpus_queries, translation_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
