"""The queries of this subpackage and the SQL that holds for some of them."""

from __future__ import annotations

from tagloom.llm import decontamination, embedding_dedup, language_id, line_dedup, ngram_join, packing, pii, substring_dedup, toxicity, url_filter

MODULES = (toxicity, decontamination, packing, language_id, url_filter, ngram_join, embedding_dedup, pii, line_dedup, substring_dedup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
