"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm import op01_bpe, op02_toxicity, op03_telephony, op04_quality, op05_licenses, op06_substring, op07_mixing, op08_chat, op09_embeddings, op10_minhash, op11_warc, op12_divergence, op13_phrases

MODULES = (op01_bpe, op02_toxicity, op03_telephony, op04_quality, op05_licenses, op06_substring, op07_mixing, op08_chat, op09_embeddings, op10_minhash, op11_warc, op12_divergence, op13_phrases)


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        found |= m.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= getattr(m, "ORACLES", {})
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
