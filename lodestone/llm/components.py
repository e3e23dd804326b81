"""Connected components by alternating large-star and small-star steps, in joins and aggregations only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def of_key(df: DataFrame, key: str, **aggregates) -> DataFrame:
    """One row for each value of ``key``, to be joined with rows of the same key. The key is computed anew, so the join
    deals the aggregate out by itself: a join of two plain exchanges is one whose hot keys AQE can split."""
    out = df.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)))


#: Edges of a partition that Python joins into trees: some 20 MB.
PART = 100_000


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """The same components in fewer edges: those of each partition become stars around their smallest node, by union-find.
    Also the number of partitions, which follows from the number of edges, so none grows with the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        kind = None
        for batch in batches:
            kind = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if kind is not None:
            ends = [(x, root(x)) for x in list(parent)]
            ends = [(u, v) for u, v in ends if u != v]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind.field(k).type) for k in (0, 1)], schema=kind)

    parts = edges.count() // PART + 1
    return stage(edges.coalesce(parts).mapInArrow(run, edges.schema), "cc"), parts


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any one ordered type. Returns node, root: the smallest node that links reach. Nodes
    without a link to another node have no row. Edges are contracted within partitions first. What more than one partition
    holds is joined in steps until no edge changes; their number grows as the logarithm of the longest path, and stars of any
    size are only joined with their centre."""
    e, parts = _contracted(stage(edges.filter("u <> v").select("u", "v"), "cc"))
    seen = _print(e) if parts > 1 else (0,)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = of_key(both, "u", m=F.min("v")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stage(large.distinct(), "cc")
        small = large.join(of_key(large, "u", m=F.min("v")), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stage(small.select("x.u", "x.v").filter("u <> v").distinct(), "cc")
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
