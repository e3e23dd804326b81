"""The register of queries, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lexical import document_path
from lodestone.sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that says the same."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of the documents; a null text is empty."""
    return spread(table(spark, sf_dir, "documents").select(document_path().alias("path"), F.coalesce("text", F.lit("")).alias("text")))


def benchmark_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---- pieces of the SQL ----

PATH = "(coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(doc_id::VARCHAR, '') || '.md')"
DOCS = f"docs AS (SELECT {PATH} AS path, coalesce(text, '') AS text FROM documents)"
TASKS = "tasks AS (SELECT item_id AS query_id, text FROM benchmark)"


def words(x: str) -> str:
    """The identifier words; the look-ahead of the original is written as three cuts."""
    cut = x
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z0-9])([A-Z])", "([A-Z])([0-9])"):
        cut = f"regexp_replace({cut}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({cut}, '[A-Za-z0-9]+'), lambda w: lower(w))"


def eval_words(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"regexp_extract_all(lower({cut}), '[a-z0-9]+')"


def listed(items) -> str:
    return "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + ")"
