"""Queries of this folder by name, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and query of each operator.
OPERATORS = {
    "op1_token_counts": "token_counts",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_chat_format": "chat",
    "op4_pii": "pii",
    "op5_quality_rules": "quality",
    "op6_license_scan": "licenses",
    "op7_simhash": "simhash",
    "op8_decontamination": "decontaminate",
    "op9_bpe_codec": "bpe_codec",
    "op10_language_id": "langid",
    "op11_line_dedup": "line_dedup",
    "op12_tokenizer_alignment": "alignment",
    "op13_ranked_search": "search",
}


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    import corpus_pipeline

    found, sql = {"pipeline": corpus_pipeline.run}, {}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    for name, module in OPERATORS.items():
        loaded = import_module(f"flowsieve.llm.{module}")
        found[name] = getattr(loaded, name)
        if getattr(loaded, "SQL", None):
            sql[name] = loaded.SQL
    return found, sql
