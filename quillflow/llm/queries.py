"""All queries of this subpackage."""

from __future__ import annotations

from quillflow.llm import q_answers, q_charforms, q_leaks, q_mixing, q_overlaps, q_repetition, q_residue, q_splits

MODULES = [q_splits, q_charforms, q_repetition, q_answers, q_overlaps, q_leaks, q_mixing, q_residue]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
