"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from . import fingerprints, language_model, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, toxicity, url_filters

_MODULES = (url_filters, packing, fingerprints, quality_rules, near_dedup, quality_classifier, mixing, language_model, toxicity, token_counts)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
