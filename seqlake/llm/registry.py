"""Names of the queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to module; each module has query() and ORACLE_SQL (None where SQL cannot express it).
MODULES = {
    "op1_suffix_dedup": "substrings",
    "op2_ngram_join": "neardup",
    "op3_quality_model": "quality_model",
    "op4_quality_rules": "quality_rules",
    "op5_sharding": "sharding",
    "op6_decontamination": "decontaminate",
    "op7_toxicity": "toxicity",
    "op8_url_filter": "urlfilter",
    "op9_secret_scan": "secrets",
    "op10_mixing": "mixing",
}


def _module(name: str):
    return import_module(f"seqlake.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := _module(name).ORACLE_SQL)}
