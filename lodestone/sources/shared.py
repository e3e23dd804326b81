"""Cutting the lineage of iterative jobs by tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session in local mode that names none gets a temporary one; on a
    cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet and read again: a lost executor costs one read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the input has fewer parts than there are cores (one small file, say). Larger
    inputs are read in parts anyway and pass unchanged, without a shuffle. Rows are dealt by their number: without one Spark
    sorts all rows of a part first, texts too, in one task's memory."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.withColumn("_nth", F.monotonically_increasing_id()).repartition(cores, "_nth").drop("_nth")
