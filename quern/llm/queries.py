"""The queries of the training-data operators over the shared tables, and the SQL of those that SQL can express.

Each is thin: it reads the whole table, applies its operator and derives digest columns from the operator's output.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and, where SQL can express them, ORACLE.
MODULES = ("q_chat", "q_warc", "q_exact_dedup", "q_media", "q_langid", "q_bpe", "q_token_files", "q_toxicity", "q_mixing", "q_minhash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"quern.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quern.llm.{name}"), "ORACLE", {})
    return out
