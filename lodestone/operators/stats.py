"""Seeded draws: a counter-based generator, bootstrap intervals, samples without replacement.

The generator's k-th number depends on the seed and on k alone, so draws of a whole sample are one
vector operation. Groups here are the tasks of one evaluation, which are bounded; rows of a corpus never come here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS, ALPHA = 1000, 0.05
STEP = 0x6D2B79F5
INTERVAL = "n long, mean double, ci_low double, ci_high double, excludes_zero boolean"


def uniform(seed: int, first: int, count: int) -> np.ndarray:
    """Numbers ``first`` to ``first + count`` of the stream: 32-bit arithmetic, modulo 2**32."""
    u, mask = np.uint64, np.uint64(0xFFFFFFFF)
    a = (u(seed & 0xFFFFFFFF) + np.arange(first + 1, first + count + 1, dtype=np.uint64) * u(STEP)) & mask
    t = ((a ^ (a >> u(15))) * (a | u(1))) & mask
    t = (t ^ (t + ((t ^ (t >> u(7))) * (t | u(61))))) & mask
    return (t ^ (t >> u(14))).astype(np.float64) / 4294967296


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    data = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(data), 2):
        h = (h ^ (data[k] | data[k + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h


def bootstrap(values: np.ndarray, seed: int, draws: int = DRAWS, alpha: float = ALPHA) -> tuple[float, float, float]:
    """Mean and percentile interval of the mean; zeros without values."""
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0
    means = np.empty(draws)
    block = max(1, 1_000_000 // n)
    for at in range(0, draws, block):
        k = min(block, draws - at)
        index = (uniform(seed, at * n, k * n) * n).astype(np.int64).reshape(k, n)
        means[at : at + k] = values[index].sum(1) / n
    means.sort()
    return float(values.sum() / n), float(means[math.floor(alpha / 2 * draws)]), float(means[math.ceil((1 - alpha / 2) * draws) - 1])


def intervals(values: DataFrame, by: list[str], column: str, seed: int, order: str = "task_id") -> DataFrame:
    """``by`` and INTERVAL for each group of ``values`` in the order of ``order``."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema if f.name in by)

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values(order)[column].to_numpy(np.float64)
        mean, low, high = bootstrap(x, seed)
        return pd.DataFrame([[*key, len(x), mean, low, high, bool(low > 0 or high < 0)]], columns=[*by, "n", "mean", "ci_low", "ci_high", "excludes_zero"])

    return values.select(*by, order, column).groupBy(*by).applyInPandas(run, f"{kinds}, {INTERVAL}")


def paired_interval(a: DataFrame, b: DataFrame, measure: str, seed: int) -> DataFrame:
    """One row: the interval of the mean difference over tasks that both have; zeros if they aren't the same tasks."""
    d = a.select("task_id", F.col(measure).alias("x")).join(b.select("task_id", F.col(measure).alias("y")), "task_id", "full")
    d = d.select(F.lit(0).alias("g"), "task_id", (F.col("x") - F.col("y")).alias("diff"))
    out = intervals(d, ["g"], "diff", seed).drop("g")
    whole = d.agg(F.bool_and(F.col("diff").isNotNull()).alias("whole"))
    zero = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(0.0).alias(c)
    return out.crossJoin(F.broadcast(whole)).select(F.when(F.col("whole"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"), zero("mean"), zero("ci_low"), zero("ci_high"), (F.col("whole") & F.col("excludes_zero")).alias("excludes_zero"))


def draw_without_replacement(pool: list, take: int, seed: int) -> list:
    """``take`` items, drawn one after the other; the order of the rest stays."""
    pool, out = list(pool), []
    for u in uniform(seed, 0, min(take, len(pool))):
        out.append(pool.pop(int(u * len(pool)) % len(pool)))
    return out


def shuffled(items: list, seed: int) -> list:
    """A seeded permutation, from the end to the front."""
    out = list(items)
    for u, k in zip(uniform(seed, 0, max(0, len(out) - 1)), range(len(out) - 1, 0, -1), strict=True):
        j = int(u * (k + 1))
        out[k], out[j] = out[j], out[k]
    return out


def reveal(gold: DataFrame) -> DataFrame:
    """gold: task_id (string), path. Adds revealed: half of each task's files, rounded up, drawn by the task's id."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(set(d["path"]))
        chosen = set(draw_without_replacement(paths, math.ceil(len(paths) / 2), fnv1a(d["task_id"].iloc[0]) ^ 0x5EED))
        return pd.DataFrame({"task_id": d["task_id"].iloc[0], "path": paths, "revealed": [p in chosen for p in paths]})

    return gold.groupBy("task_id").applyInPandas(run, "task_id string, path string, revealed boolean")


def decoys(pool: DataFrame, count: int, salt: int = 0x7DE1) -> DataFrame:
    """pool: task_id, path of the files that may be drawn. task_id, path: ``count`` of each."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        out = sorted(draw_without_replacement(sorted(set(d["path"])), count, fnv1a(d["task_id"].iloc[0]) ^ salt))
        return pd.DataFrame({"task_id": d["task_id"].iloc[0], "path": out})

    return pool.groupBy("task_id").applyInPandas(run, "task_id string, path string")


def decoy_places(excluded: list[int], n: int, count: int, seed: int) -> list[int]:
    """Places (from 1) in a list of ``n`` of ``count`` items drawn without replacement from those not excluded."""
    gone = sorted(set(excluded))
    out = []
    for u in uniform(seed, 0, min(count, n - len(gone))):
        place = int(u * (n - len(gone))) % (n - len(gone)) + 1
        for g in gone:
            place += g <= place
        gone = sorted([*gone, place])
        out.append(place)
    return sorted(out)


def random_decoys(ranked: DataFrame, gold: DataFrame, salt: int = 0x7DE1) -> DataFrame:
    """ranked: path, place (1, 2, … by path); gold: task_id, path, revealed. task_id, path: for each task as many other files as
    are revealed. Places are drawn, and only drawn files are looked up: no task meets all files."""
    n = ranked.agg(F.count("*")).first()[0]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        took = decoy_places(d["place"].dropna().astype(int).tolist(), n, int(d["revealed"].sum()), fnv1a(d["task_id"].iloc[0]) ^ salt)
        return pd.DataFrame({"task_id": d["task_id"].iloc[0], "place": took})

    placed = gold.join(ranked, "path", "left").select("task_id", "place", "revealed")
    return placed.groupBy("task_id").applyInPandas(run, "task_id string, place long").join(ranked, "place").select("task_id", "path")


def same_folder_decoys(files: DataFrame, gold: DataFrame, salt: int = 0xD0C0) -> DataFrame:
    """files: path; gold: task_id, path, revealed. task_id, path: for each task as many files beside revealed ones as are revealed,
    the next ones by path from a drawn place on, round the end. Folders are counted, not gathered."""
    from lodestone.operators.ranks import ordered_rank

    folder = F.regexp_replace("path", "/?[^/]*$", "").alias("folder")
    every = gold.select("path").distinct()
    pool = ordered_rank(files.select("path", folder), ["folder", "path"], "place")
    pool = pool.join(every.withColumn("_gold", F.lit(True)), "path", "left")
    ends = pool.groupBy("folder").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    tasks = gold.groupBy("task_id").agg(F.count_if("revealed").alias("count"))
    spans = gold.filter("revealed").select("task_id", folder).distinct().join(ends, "folder").join(tasks, "task_id")
    known = gold.join(pool.select("path", "place"), "path").groupBy("task_id").agg(F.sort_array(F.collect_list("place")).alias("gone"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        gone, count = set(d["gone"].iloc[0]), int(d["count"].iloc[0])
        spans = sorted(zip(d["folder"], d["first"], d["n"], strict=True))
        total = sum(n for _, _, n in spans) - sum(any(f <= g < f + n for _, f, n in spans) for g in gone)
        out: list[int] = []
        if total > 0:
            start = int(uniform(fnv1a(d["task_id"].iloc[0]) ^ salt, 0, 1)[0] * total) % total
            left = min(count, total)
            for lap in (0, 1):  # candidates in order, from the drawn one on, then those before it
                at = 0
                for _, first, n in spans:
                    inside = sorted(g for g in gone if first <= g < first + n)
                    free = n - len(inside)
                    low = max(0, start - at) if lap == 0 else 0
                    k = low
                    while k < free and left and (lap == 0 or at + k < start):
                        place = first + k
                        for g in inside:
                            place += g <= place
                        out.append(int(place))
                        left, k = left - 1, k + 1
                    at += free
        return pd.DataFrame({"task_id": d["task_id"].iloc[0], "place": out})

    drawn = spans.join(known, "task_id").groupBy("task_id").applyInPandas(run, "task_id string, place long")
    return drawn.join(pool.select("path", "place"), "place").select("task_id", "path")


def strip_revealed(rankings: DataFrame, revealed: DataFrame) -> DataFrame:
    """Rankings without the files that a task has revealed."""
    return rankings.join(revealed.filter("revealed").select("task_id", "path"), ["task_id", "path"], "left_anti")


def random_ranking(snapshots: DataFrame, tasks: DataFrame, seed: int) -> DataFrame:
    """snapshots: task_id, path; tasks: task_id, text. task_id, path, rank: every file of the snapshot in an order that the text draws."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        order = shuffled(sorted(d["path"]), fnv1a(d["text"].iloc[0]) ^ (seed & 0xFFFFFFFF))
        return pd.DataFrame({"task_id": d["task_id"].iloc[0], "path": order, "rank": range(1, len(order) + 1)})

    kind = dict(snapshots.dtypes)["task_id"]
    return snapshots.join(tasks.select("task_id", "text"), "task_id").groupBy("task_id").applyInPandas(run, f"task_id {kind}, path string, rank int")


def time_split(commits: DataFrame) -> DataFrame:
    """Adds half: ``tuning`` for the earlier half by (committer_time, sha), ``eval`` for the later."""
    from lodestone.operators.ranks import global_rank

    ranked = global_rank(commits.withColumn("_t", F.col("committer_time").cast("double")), "_t", ["sha"], out="_rank")
    n = commits.agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn("half", F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "tuning").otherwise("eval")).drop("_t", "_rank", "_n")


def sample_places(sizes: DataFrame, count: int, seed: int) -> DataFrame:
    """sizes: repo_id, n. repo_id, place (from 1): ``count`` distinct places of each repository's pool, drawn with replacement until enough;
    no pool is gathered."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n, picked = int(d["n"].iloc[0]), []
        for u in uniform(seed, 0, count * 100):
            if len(picked) >= min(count, n):
                break
            k = int(u * n) % n
            if k not in picked:
                picked.append(k)
        return pd.DataFrame({"repo_id": d["repo_id"].iloc[0], "place": [k + 1 for k in sorted(picked)]})

    return sizes.groupBy("repo_id").applyInPandas(run, "repo_id string, place long")
