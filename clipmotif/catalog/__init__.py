"""The operators applied to whole synthetic tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from clipmotif.catalog import discovery, planted, regions, sequences


def queries() -> dict:
    return sequences.QUERIES | regions.QUERIES | discovery.QUERIES | planted.QUERIES


def oracle_sql() -> dict[str, str]:
    return sequences.SQL | regions.SQL | discovery.SQL | planted.SQL
