"""Queries of the training-data operators, by name."""

from __future__ import annotations

from . import block_max, bpe, clustering, decontamination, host_rules, html_extraction, lm_scoring, nearest, ngram_jaccard, oracles, sharding, substring_dedup, token_counts, toxicity


def queries():
    return {
        "op1_html_extraction": html_extraction.query,
        "op2_sharding": sharding.query,
        "op3_toxicity": toxicity.query,
        "op4_bpe": bpe.query,
        "op5_ngram_jaccard": ngram_jaccard.query,
        "op6_decontamination": decontamination.query,
        "op7_nearest": nearest.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_token_counts": token_counts.query,
        "op10_lm_scoring": lm_scoring.query,
        "op11_clustering": clustering.query,
        "op12_host_rules": host_rules.query,
        "op13_block_max": block_max.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_html_extraction": oracles.html_extraction(),
        "op5_ngram_jaccard": oracles.ngram_jaccard(),
        "op6_decontamination": oracles.decontamination(),
        "op7_nearest": oracles.nearest(),
        "op8_substring_dedup": oracles.substring_dedup(),
        "op10_lm_scoring": oracles.lm_scoring(),
        "op11_clustering": oracles.clustering(),
        "op12_host_rules": oracles.host_rules(),
        "op13_block_max": oracles.block_max(),
    }
