"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

# Query name, module.
NAMES = {
    "op1_decontaminate": "decontaminate",
    "op2_substring_dedup": "substring",
    "op3_quality": "quality",
    "op4_url_filter": "urlfilter",
    "op5_token_counts": "tokencount",
    "op6_lm_score": "lmscore",
    "op7_bpe": "bpe",
    "op8_token_file": "tokenfile",
    "op9_simhash": "simhash",
    "op10_embedding": "embedding",
    "op11_merkle": "merkle",
    "op12_cluster": "cluster",
    "op13_phrases": "phrases",
}


def _call(module: str, name: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline

    return {name: _call(module, name) for name, module in NAMES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import cluster, merkle, urlfilter

    return {"op4_url_filter": urlfilter.SQL, "op11_merkle": merkle.SQL, "op12_cluster": cluster.SQL}
