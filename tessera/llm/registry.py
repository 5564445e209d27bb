"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import divergence, exact_dedup, language, line_dedup, near_dedup, packing, pieces, quality, ranked_search, substring_dedup, toxicity, url_rules, webp

_MODULES = [webp, substring_dedup, language, near_dedup, packing, toxicity, url_rules, exact_dedup, pieces, quality, line_dedup, ranked_search, divergence]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
