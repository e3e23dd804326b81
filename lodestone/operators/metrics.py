"""Retrieval metrics over many tasks and systems at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["top1", "recall5", "recall8", "recall10", "all_gold10", "mrr"]


def gold_ranks(gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """gold: task_id, path; rankings: system, task_id, path, rank. system, task_id, path, rank (null if not ranked) for every system and gold file."""
    systems = rankings.select("system").distinct()
    return gold.crossJoin(F.broadcast(systems)).join(rankings, ["system", "task_id", "path"], "left").select("system", "task_id", "path", "rank")


def task_metrics(tasks: DataFrame, ranks: DataFrame) -> DataFrame:
    """tasks: task_id; ranks: as of gold_ranks. system, task_id and MEASURES. A task without gold has recall 1 and,
    as nothing is ranked, a reciprocal rank of 0."""
    best = F.min("rank")
    per = ranks.groupBy("system", "task_id").agg(
        F.count("*").alias("n"), best.alias("best"), *[F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in (5, 8, 10)],
    )
    every = tasks.select("task_id").crossJoin(F.broadcast(ranks.select("system").distinct())).join(per, ["system", "task_id"], "left")
    share = lambda k: F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.col(f"hit{k}") / F.col("n"))
    return every.select(
        "system", "task_id", F.when(F.col("best") == 1, 1.0).otherwise(0.0).alias("top1"), share(5).alias("recall5"), share(8).alias("recall8"), share(10).alias("recall10"),
        F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).when(F.col("hit10") == F.col("n"), 1.0).otherwise(0.0).alias("all_gold10"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"),
    )


def summarise(per_task: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    return per_task.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in MEASURES])


def package_recall(gold: DataFrame, packages: DataFrame) -> DataFrame:
    """gold: task_id, path; packages: system, task_id, path. system, task_id, package_recall."""
    systems = packages.select("system").distinct()
    per = gold.crossJoin(F.broadcast(systems)).join(packages.select("system", "task_id", "path", F.lit(1).alias("hit")).distinct(), ["system", "task_id", "path"], "left")
    return per.groupBy("system", "task_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("package_recall"))


def paired(a: DataFrame, b: DataFrame, measure: str) -> DataFrame:
    """task_id, a, b, diff of the tasks that both have."""
    x, y = a.select("task_id", F.col(measure).alias("a")), b.select("task_id", F.col(measure).alias("b"))
    return x.join(y, "task_id").withColumn("diff", F.col("a") - F.col("b"))


def gaps(per_task: DataFrame, ranks: DataFrame, system: str, baseline: str) -> DataFrame:
    """task_id, path, baseline_rank, system_rank of gold that the baseline has whole in its first ten and the system hasn't."""
    full = per_task.filter("all_gold10 = 1.0")
    lost = full.filter(F.col("system") == baseline).select("task_id").join(full.filter(F.col("system") == system).select("task_id"), "task_id", "left_anti")
    of = lambda s, name: ranks.filter(F.col("system") == s).select("task_id", "path", F.col("rank").alias(name))
    return lost.join(of(baseline, "baseline_rank"), "task_id").join(of(system, "system_rank"), ["task_id", "path"]).filter("system_rank is null or system_rank > 10")


def gap_buckets(per_task: DataFrame, gold: DataFrame, slices: DataFrame) -> DataFrame:
    """Means of the recalls by system, slice (task_id, slice) and number of gold files (1, 2, 3, 4+)."""
    n = gold.groupBy("task_id").agg(F.count("*").alias("g"))
    bucket = F.when(F.col("g") >= 4, "4+").otherwise(F.col("g").cast("string"))
    d = per_task.join(n, "task_id").join(slices, "task_id").withColumn("bucket", bucket)
    return d.groupBy("system", "slice", "bucket").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall5", "recall8", "recall10")])


def lower_median(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The element at floor((n - 1) / 2) of the sorted values of each group."""
    return values.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("median"))


def case_studies(per_task: DataFrame, k: int = 5) -> DataFrame:
    """system, side, place, task_id: the ``k`` best and worst tasks by reciprocal rank, then recall at ten, then id."""
    both = []
    for side, order in (("best", [F.desc("mrr"), F.desc("recall10"), "task_id"]), ("worst", ["mrr", "recall10", "task_id"])):
        w = Window.partitionBy("system").orderBy(*order)
        both.append(per_task.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("system", F.lit(side).alias("side"), "place", "task_id"))
    return both[0].unionByName(both[1])


STAGES = ["not-indexed", "security-withheld", "delivered", "not-in-candidates", "ranked-outside-top8", "packaged-metadata-only", "top8-not-packaged"]


def loss_stage(indexed, withheld, delivered, rank, why):
    """Where a gold file was lost; the arguments are Columns, ``rank`` may be null."""
    return (
        F.when(~indexed, STAGES[0]).when(withheld, STAGES[1]).when(delivered, STAGES[2]).when(rank.isNull(), STAGES[3])
        .when(rank > 8, STAGES[4]).when(why, STAGES[5]).otherwise(STAGES[6])
    )


def loss_table(records: DataFrame) -> DataFrame:
    """records: stage, is_test. stage, all, test, other: counts, for stages that occur."""
    return records.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_other"))


def field_overlap(pairs: DataFrame) -> DataFrame:
    """pairs: task_words, indexed_words, body_words (arrays). Adds verdict: what a missed file shares with its task."""
    inside = F.size(F.array_intersect("task_words", "indexed_words")) > 0
    body = F.size(F.array_intersect(F.array_except("task_words", "indexed_words"), "body_words")) > 0
    return pairs.withColumn("verdict", F.when(inside, "indexed-overlap").when(body, "body-only").otherwise("neither"))
