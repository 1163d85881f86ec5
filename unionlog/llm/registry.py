"""The queries and SQL of this subpackage."""

from __future__ import annotations

from unionlog.llm import arc_to_warc, context_mixing, decontamination, extendible_sharding, quality_classifier, quality_rules, retrieval_packing, simhash_dedup, suffix_dedup, token_counts

_MODULES = (quality_classifier, token_counts, retrieval_packing, arc_to_warc, context_mixing, extendible_sharding, quality_rules, simhash_dedup, decontamination, suffix_dedup)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
