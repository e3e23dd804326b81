"""Checkpoints as lines of JSON: what is valid, torn, repeated or foreign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_records(lines: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """lines: n, line. Adds task and state: valid; torn (the last line only, no whole JSON); corrupt (such a line
    before the last); duplicate (a task met before); foreign (not among ``expected``)."""
    d = lines.filter(F.trim("line") != "").withColumn("json", F.try_parse_json("line"))
    d = d.withColumn("task", F.when(F.col("json").isNotNull(), F.try_variant_get("json", "$.task", "string")))
    last = d.agg(F.max("n").alias("last_n"))
    first = F.min("n").over(Window.partitionBy("task"))
    d = d.join(F.broadcast(last)).withColumn("first_n", F.when(F.col("task").isNotNull(), first))
    foreign = ~F.col("task").isin(*expected) if expected is not None else F.lit(False)
    state = F.when(F.col("task").isNull(), F.when(F.col("n") == F.col("last_n"), "torn").otherwise("corrupt")).when(foreign, "foreign").when(F.col("first_n") < F.col("n"), "duplicate").otherwise("valid")
    return d.select("n", "line", "task", state.alias("state"))


def checkpoint_state(records: DataFrame, n_expected: int, same_identity: bool) -> DataFrame:
    """One row: none, pending, completed or mismatch, with the number of tasks done."""
    d = records.agg(F.count_if(F.col("state") == "valid").alias("done"), F.count("*").alias("n"))
    state = F.when(F.lit(not same_identity), "mismatch").when(F.col("n") == 0, "none").when(F.col("done") >= n_expected, "completed").otherwise("pending")
    return d.select(state.alias("state"), "done")


def repaired(records: DataFrame) -> DataFrame:
    """The lines to keep: all but a torn tail. A corrupt line inside is an error."""
    bad = F.when(F.col("state") == "corrupt", F.raise_error(F.concat(F.lit("corrupt checkpoint line "), F.col("n").cast("string"))).cast("string")).otherwise(F.col("line"))
    return records.filter("state <> 'torn'").select("n", bad.alias("line"))
