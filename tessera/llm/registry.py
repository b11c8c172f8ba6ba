"""The queries of this subpackage and the SQL that each must equal, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = ("suffix_dedup", "token_counts", "bpe", "minhash", "mixing", "quality_rules", "lm_score", "embedding_dedup", "chat", "license_scan", "whitening", "decontamination", "conversation_trie")
MODULES = [import_module(f"{__package__}.{m}") for m in NAMES]


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
