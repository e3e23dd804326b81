"""Exact running totals over an order given by a hash, without one task that sees a whole group.

The hash is cut into digits. Totals per (group, digits) are added up level by level, in windows of at
most ``2**bits`` rows; only the rows that share all digits meet in one window, a share of
``2**-(bits * levels)`` of the group. A group with a third of all rows is spread as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_digits(key: Column, bits: int, levels: int) -> list[Column]:
    """The top digits of a 64-bit hash, as ints."""
    return [F.shiftrightunsigned(key, 64 - bits * (k + 1)).bitwiseAND((1 << bits) - 1).cast("int") for k in range(levels)]


def before(df: DataFrame, group: list[str], digits: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the group that come earlier in the order
    (digits, then ``order``). Rows equal in both come one after the other in no defined order."""
    levels = df.groupBy(*group, *digits).agg(F.sum(weight).alias("_w0"))
    totals, tables = levels, []
    for depth in range(len(digits), 0, -1):
        keys = [*group, *digits[:depth]]
        if depth < len(digits):
            totals = totals.groupBy(*keys).agg(F.sum("_w0").alias("_w0"))
        w = Window.partitionBy(*group, *digits[: depth - 1]).orderBy(digits[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        tables.append(totals.select(*keys, F.coalesce(F.sum("_w0").over(w), F.lit(0)).alias(f"_b{depth}")))
    offsets = reduce(lambda a, b: a.join(b, [c for c in b.columns if c in (*group, *digits)]), tables)
    offsets = offsets.select(*group, *digits, reduce(lambda a, b: a + b, [F.col(f"_b{d}") for d in range(1, len(digits) + 1)]).alias("_before"))
    w = Window.partitionBy(*group, *digits).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inner", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    return rows.join(offsets, [*group, *digits]).withColumn(out, (F.col("_inner") + F.col("_before")).cast("long")).drop("_inner", "_before")
