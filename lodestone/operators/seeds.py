"""Change-aware seeds: which changed, open or failing files may steer a search, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.paths import is_generated_or_lockfile

MAX_EDITORS, MAX_DIAGNOSTICS = 10, 20
KIND_ORDER = ["SELECTION", "DIFF_TOUCHED", "OPEN_EDITOR", "DIAGNOSTIC", "STACK_FRAME"]


def flood_control(changes: DataFrame, limit: int, by: list[str] = ()) -> DataFrame:
    """changes: path, state. The first ``limit`` by priority of state, then path; generated files, lock files and repeats go."""
    rank = F.lit(9)
    for state, k in config.STATE_PRIORITY.items():
        rank = F.when(F.col("state") == state, k).otherwise(rank)
    d = changes.filter(~is_generated_or_lockfile(F.col("path"))).withColumn("_p", rank)
    first = d.groupBy(*by, "path").agg(F.min(F.struct("_p", "state")).alias("x")).select(*by, "path", "x.state", F.col("x._p").alias("_p"))
    w = Window.partitionBy(*by).orderBy("_p", "path") if by else None
    if w is None:
        return first.orderBy("_p", "path").limit(limit).drop("_p")
    return first.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_p", "_k")


def normalise_editors(editors: DataFrame) -> DataFrame:
    """editors: query_id, ord, path. The first MAX_EDITORS different ones in their order."""
    d = editors.groupBy("query_id", "path").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("query_id").orderBy("ord", "path")
    return d.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= MAX_EDITORS)


def normalise_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """diagnostics: query_id, path, message. First lines, each once, by path and message, MAX_DIAGNOSTICS at most."""
    d = diagnostics.select("query_id", "path", F.trim(F.element_at(F.split("message", r"\r?\n"), 1)).alias("message")).distinct()
    w = Window.partitionBy("query_id").orderBy("path", "message")
    return d.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= MAX_DIAGNOSTICS)


def hints(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """seeds: query_id, path, kind, detail; files: path. One hint for each indexed path: the kind that comes first."""
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    known = seeds.join(files.select("path"), "path", "left_semi")
    return known.groupBy("query_id", "path").agg(F.min(F.struct(order.alias("o"), "kind", "detail")).alias("x")).select("query_id", "path", "x.kind", "x.detail")


def cut_at_line(text: str, max_bytes: int) -> str:
    """The text within ``max_bytes`` of UTF-8, cut behind the last line feed that fits; whole if it fits."""
    data = text.encode()
    if len(data) <= max_bytes:
        return text
    at = data.rfind(b"\n", 0, max(0, max_bytes))
    return data[: at + 1].decode() if at >= 0 else ""
