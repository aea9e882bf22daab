"""All core queries and their SQL counterparts."""

from __future__ import annotations

from quillflow.plans import nested, pages, pools, scoring

MODULES = [nested, pools, scoring, pages]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
