"""All queries of this library but those of the llm subpackage, by name."""

from __future__ import annotations

from codegrain.plans import relation_plans, text_plans


def queries() -> dict:
    assert relation_plans.query is text_plans.query
    return dict(text_plans.QUERIES)


def oracle_sql() -> dict:
    return dict(text_plans.SQL)
