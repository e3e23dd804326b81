"""Seed simulation: what revealing half of a task's files does to finding the other half, arm by arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import RETRIEVAL, Retrieval
from lodestone.operators import baselines, stats
from lodestone.operators.ranks import ordered_rank
from lodestone.plans.retrieve import Corpus, retrieve
from lodestone.sources.shared import written

#: Arms that search with seeds: what they reveal, whether seeds get slots of their own, and what neighbours of seeds get.
ARMS = {
    "unseeded": ("nothing", "slots", 0.0), "seeded": ("revealed", "slots", 0.0), "s1": ("revealed", "signal-only", 0.0), "s2": ("revealed", "signal-only", 0.4),
    "decoy-samedir": ("samedir", "signal-only", 0.0), "mixed": ("mixed", "signal-only", 0.0), "random-decoy": ("random", "signal-only", 0.0), "realdiff": ("diff", "slots", 0.0),
}
PACKAGE = 8


def seeds_by_arm(files: DataFrame, shown: DataFrame) -> DataFrame:
    """files: path; shown: task_id, path, revealed. source, task_id, path."""
    revealed = shown.filter("revealed").select("task_id", "path")
    random = written(stats.random_decoys(ordered_rank(files.select("path"), ["path"], "place"), shown), "decoys")
    beside = written(stats.same_folder_decoys(files, shown), "beside")
    # Half of what is revealed, rounded up, and as many decoys as are missing.
    half = lambda d, up: d.groupBy("task_id").agg(F.sort_array(F.collect_list("path")).alias("p")).select("task_id", F.explode(F.slice("p", F.lit(1), up(F.size("p") / 2).cast("int"))).alias("path"))
    n = revealed.groupBy("task_id").agg(F.floor(F.count("*") / 2).cast("int").alias("n"))
    others = beside.groupBy("task_id").agg(F.sort_array(F.collect_list("path")).alias("p")).join(n, "task_id").select("task_id", F.explode(F.slice("p", F.lit(1), F.col("n"))).alias("path"))
    named = lambda d, name: d.select(F.lit(name).alias("source"), "task_id", "path")
    out = named(revealed, "revealed").unionByName(named(revealed, "diff")).unionByName(named(beside, "samedir"))
    return out.unionByName(named(half(revealed, F.ceil).unionByName(others), "mixed")).unionByName(named(random, "random"))


def simulate(corpus: Corpus, texts: DataFrame, tasks: DataFrame, gold: DataFrame, diffs: DataFrame | None = None, cfg: Retrieval = RETRIEVAL) -> DataFrame:
    """texts: path, text; tasks: task_id (string), text; gold: task_id, path; diffs: task_id, text of what revealed files changed.
    system, task_id, path, rank of every arm, without the files that the task reveals, for tasks that hide a file.

    Tasks of all arms are the queries of one search, in which those of like words are scored once."""
    shown = written(stats.reveal(gold), "reveal")
    scored = tasks.join(shown.filter(~F.col("revealed")).select("task_id").distinct(), "task_id", "left_semi")
    seeds = written(seeds_by_arm(texts, shown), "arm-seeds")
    arms = tasks.sparkSession.createDataFrame([(a, src, s == "slots", b) for a, (src, s, b) in ARMS.items()], "system string, source string, slot boolean, boost double")
    q = scored.crossJoin(F.broadcast(arms)).withColumn("query_id", F.concat("system", F.lit("|"), "task_id"))  # a row for each arm
    if diffs is not None:
        q = q.join(diffs.select("task_id", F.col("text").alias("diff")), "task_id", "left").withColumn("text", F.when(F.col("source") == "diff", F.concat_ws(" ", "text", "diff")).otherwise(F.col("text")))
    q = written(q.select("query_id", "task_id", "source", "slot", "boost", "text"), "arm-queries")
    hints = q.join(seeds, ["source", "task_id"]).select("query_id", "path", F.lit("DIFF_TOUCHED").alias("kind"), F.lit("").alias("detail"), "slot", "boost")
    _, ranking = retrieve(corpus, q.select("query_id", "text"), cfg, hints=hints)
    out = ranking.select(F.substring_index("query_id", "|", 1).alias("system"), F.expr("substring(query_id, instr(query_id, '|') + 1)").alias("task_id"), "path", "rank")
    names = shown.filter("revealed").groupBy("task_id").agg(F.array_join(F.sort_array(F.collect_list("path")), " ").alias("names"))
    plain = scored.join(names, "task_id", "left").select(F.col("task_id").alias("query_id"), F.concat_ws(" ", "text", "names").alias("text"))
    okapi = baselines.ranked(baselines.bm25(texts, plain, cfg.limit), cfg.limit).select(F.lit("bm25names").alias("system"), F.col("query_id").alias("task_id"), "path", "rank")
    kept = stats.strip_revealed(out.unionByName(okapi), shown)
    from pyspark.sql import Window

    w = Window.partitionBy("system", "task_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w))
