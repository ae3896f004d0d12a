"""All queries over the test tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from tallyloom.plans import checks, flows, measures, papers, reviews, rosters, texts
from tallyloom.plans.registry import Query


def queries() -> dict[str, Query]:
    return measures.query.queries | texts.query.queries | rosters.query.queries | reviews.query.queries | flows.query.queries | papers.query.queries | checks.query.queries


def oracle_sql() -> dict[str, str]:
    return measures.query.sql | texts.query.sql | rosters.query.sql | reviews.query.sql | flows.query.sql | papers.query.sql | checks.query.sql
