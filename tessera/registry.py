"""Queries over the driver tables for the library's own operators, and their SQL."""

from __future__ import annotations

from tessera.plans import answers, checks, evaluation, evidence_sql, gap_plan, operations, recovery, relations, retrieval, runs, summaries, text, vectors

_MODULES = [text, retrieval, answers, evaluation, operations, summaries, runs, relations, vectors, checks, gap_plan, recovery]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in [*_MODULES, evidence_sql] for name, sql in module.ORACLES.items()}
