"""All queries over panels, by name, and the SQL that each must equal."""

from __future__ import annotations

from . import descriptive, models, reports, streams

MODULES = (descriptive, models, reports, streams)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
