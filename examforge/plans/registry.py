"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from examforge.plans import attempts, catalog, checks, literal, quizzes, texts

MODULES = (attempts, quizzes, catalog, texts, checks, literal)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.plans.sql.items()}
