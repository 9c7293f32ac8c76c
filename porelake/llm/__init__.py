"""Operators for training-data pipelines: thirteen operators, one query each, and the corpus pipeline."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# query name -> module that holds it; a module may hold ORACLE_SQL for its query
MODULES = {
    "op1_topk_search": "topk_search",
    "op2_secret_scan": "secret_scan",
    "op3_quality_rules": "quality_rules",
    "op4_simhash_dedup": "simhash_dedup",
    "op5_toxicity": "toxicity",
    "op6_suffix_dedup": "suffix_dedup",
    "op7_bpe_round_trip": "bpe_codec",
    "op8_source_mixing": "source_mixing",
    "op9_token_counts": "token_counts",
    "op10_window_dedup": "window_dedup",
    "op11_collocations": "collocations",
    "op12_hard_negatives": "hard_negatives",
    "op13_url_filter": "url_filter",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"porelake.llm.{MODULES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {n: getattr(importlib.import_module(f"porelake.llm.{m}"), "ORACLE_SQL", None) for n, m in MODULES.items()}
    return {n: s for n, s in found.items() if s}
