"""Folder trees and the architecture summary: rollups over the ancestors of every path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import detect_language, dir_name
from lodestone.sources.scan import ancestors
from lodestone.sources.shared import written

MAX_DEPTH, MAX_ENTRIES = 4, 400


def folder_counts(files: DataFrame) -> DataFrame:
    """path, file_count of every folder, the root as an empty path: files anywhere below it."""
    folders = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    return files.select(F.explode(folders).alias("path")).groupBy("path").agg(F.count("*").alias("file_count"))


def tree_nodes(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """path, parent, name, depth, is_dir, file_count, sort_key down to ``max_depth``. Sorting by sort_key walks the
    tree: in each folder first folders, then files, each by name."""
    dirs = folder_counts(files).filter("path <> ''").withColumn("is_dir", F.lit(True))
    own = files.select("path", F.lit(1).cast("long").alias("file_count"), F.lit(False).alias("is_dir"))
    d = dirs.select("path", "file_count", "is_dir").unionByName(own).withColumn("parts", F.split("path", "/"))
    d = d.withColumn("depth", F.size("parts")).filter(F.col("depth") <= max_depth)
    key = F.array_join(F.transform("parts", lambda p, i: F.concat(F.when((i < F.col("depth") - 1) | F.col("is_dir"), F.lit("0")).otherwise("1"), p)), "\u0001")
    return d.select("path", dir_name(F.col("path")).alias("parent"), F.element_at("parts", -1).alias("name"), "depth", "is_dir", "file_count", key.alias("sort_key"))


def tree_lines(files: DataFrame, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """ord, line of the drawn tree, ``max_entries`` at most. The entries are cut before anything is drawn."""
    nodes = tree_nodes(files, max_depth)
    # The last entry of a folder by an aggregate: a folder with a third of all files is no task of its own.
    lasts = nodes.groupBy("parent").agg(F.max("sort_key").alias("last_key"))
    few = F.broadcast(nodes.orderBy("sort_key").limit(max_entries))
    top = written(lasts.join(few, "parent").withColumn("is_last", F.col("sort_key") == F.col("last_key")).drop("last_key"), "tree-top")
    marks = top.select(F.col("path").alias("above"), F.col("is_last").alias("above_last"))
    up = top.select("path", F.posexplode_outer(ancestors(F.col("path"))).alias("k", "above")).join(F.broadcast(marks), "above", "left")
    bars = up.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "above_last")))), lambda x: F.when(x["above_last"], "    ").otherwise("│   ")), "").alias("bars"))
    label = F.when(F.col("is_dir"), F.concat(F.col("name"), F.lit("/ ("), F.col("file_count").cast("string"), F.lit(" files)"))).otherwise(F.concat(F.col("name"), F.lit(" ["), detect_language(F.col("path")), F.lit("]")))
    drawn = top.join(bars, "path").withColumn("line", F.concat("bars", F.when(F.col("is_last"), "└── ").otherwise("├── "), label))
    return drawn.select(F.row_number().over(Window.orderBy("sort_key")).alias("ord"), "line")  # max_entries rows at most


def top_folders(files: DataFrame, k: int = 12) -> DataFrame:
    """path, file_count of the fullest folders, the files that lie right in them."""
    direct = files.select(dir_name(F.col("path")).alias("path")).groupBy("path").agg(F.count("*").alias("file_count"))
    return direct.orderBy(F.desc("file_count"), "path").limit(k)


def external_packages(edges: DataFrame, k: int = 30) -> DataFrame:
    e = edges.filter(F.col("source").startswith("file:") & F.col("target").startswith("external:"))
    return e.select(F.substr("target", F.lit(10), F.length("target")).alias("package")).distinct().orderBy("package").limit(k)
