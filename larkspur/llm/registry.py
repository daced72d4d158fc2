"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, jaccard_join, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules, sharding

_MODULES = (chat_format, line_dedup, language_id, decontamination, jaccard_join, quality_classifier, mixing, sharding, pii, quality_rules)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
