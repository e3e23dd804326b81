"""All queries by name, with the SQL that states the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import base

MODULES = ["text_queries", "lexical_queries", "eval_queries", "graph_queries", "code_queries", "security_queries", "context_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodestone.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
