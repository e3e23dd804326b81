"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written

PARTS = 1024


def cut_points(df: DataFrame, key: str, parts: int = PARTS) -> list[float]:
    """At most ``parts`` approximate quantiles of a numeric key: the only thing that the driver sees."""
    shares = [k / parts for k in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(key), shares, 10_000).alias("q")).first()["q"]
    return sorted(set(got or []))


def global_rank(df: DataFrame, key: str, ties: list[str], descending: bool = False, out: str = "rank") -> DataFrame:
    """Adds 1, 2, … by ``key`` (a double; nulls last), then ``ties`` ascending. Rows are dealt into ranges of the
    key; each range is numbered by itself and shifted by the sizes of the ranges before. Rows that
    share one key share a range, so the key should have many values. The ranges need not be exact for the result to be."""
    cuts = cut_points(df, key)
    side = F.col(key) * (-1 if descending else 1)
    cuts = sorted(-c for c in cuts) if descending else cuts
    place: Column = F.lit(0)
    dealt = df
    if cuts:
        # A binary search in the JVM; what equals a cut lies behind it, so equal keys share a range.
        find = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_side", outputCol="_at", handleInvalid="keep")
        dealt = find.transform(df.withColumn("_side", F.coalesce(side, F.lit(0.0))))
        place = F.when(F.col(key).isNull(), len(cuts) + 2).otherwise(F.col("_at").cast("int"))
    dealt = dealt.withColumn("_range", place.cast("int")).drop("_side", "_at")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # PARTS + 1 rows at most
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    order = [F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), *ties]
    inner = dealt.withColumn("_inner", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inner.join(F.broadcast(sizes), "_range").withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_range", "_before", "_inner")


def ordered_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Adds 1, 2, … by any columns, strings too. Rows are dealt into ranges by a sample of them, and the ranges written, since
    another sample would deal them otherwise; each is numbered by itself and shifted by the sizes of the ranges before."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each shuffle partition
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inner = dealt.withColumn("_inner", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inner.join(F.broadcast(sizes), "_range").withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_range", "_before", "_inner")


def group_rank(df: DataFrame, by: str, order: list[str], out: str = "rank", size: str = "n") -> DataFrame:
    """Adds 1, 2, … within each group by ``order``, and the group's size. Groups may be few and large: they are cut into ranges too.
    Rows without a group go."""
    d = ordered_rank(df, [by, *order], "_place")
    groups = written(d.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias(size)), "groups")
    groups = F.broadcast(groups) if groups.count() <= 100_000 else groups  # counted
    return d.join(groups, by).withColumn(out, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def top(df: DataFrame, k: int, order: list[Column | str], by: list[str]) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each task's groups to ``k`` before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
