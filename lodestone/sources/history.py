"""Exported version-control output as tables: logs, status, trees. The engine itself starts no process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Field, header and record separators of the exported log.
UNIT, STACK, RECORD = "\u001f", "\u001d", "\u001e"


def recency(lines: DataFrame) -> DataFrame:
    """lines: ord, line of a log in which a number (seconds) stands before the files of its commit.
    path, last_touch, rank (from 0, newest first, ties by path)."""
    mark = F.when(F.col("line").rlike(r"^\d+$"), F.col("line").cast("long"))
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines if "source" in lines.columns else lines.withColumn("source", F.lit(""))
    files = d.withColumn("ts", F.last(mark, ignorenulls=True).over(w)).filter(mark.isNull() & (F.trim("line") != "") & F.col("ts").isNotNull())
    last = files.groupBy("source", F.trim("line").alias("path")).agg(F.max("ts").alias("last_touch"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("last_touch"), "path")) - 1)


def parse_status(text: Column) -> Column:
    """array<struct<path, state, old_path>> from NUL-separated status output; a rename is followed by its old path."""
    items = F.filter(F.split(text, "\x00"), lambda x: x != "")

    def step(acc: Column, item: Column) -> Column:
        code, path = F.substring(item, 1, 2), F.substr(item, F.lit(4), F.length(item))
        state = (
            F.when(code == "??", "untracked").when(F.contains(code, F.lit("D")), "deleted").when(~F.substring(code, 1, 1).isin(" ", "?"), "staged").otherwise("unstaged")
        )
        entry = F.struct(path.alias("path"), state.alias("state"), F.lit(None).cast("string").alias("old_path"))
        renamed = F.transform(acc["out"], lambda x, i: F.when(i == F.size(acc["out"]) - 1, F.struct(x["path"].alias("path"), x["state"].alias("state"), item.alias("old_path"))).otherwise(x))
        return F.when(acc["wait"], F.struct(F.lit(False).alias("wait"), renamed.alias("out"))).otherwise(F.struct(code.rlike("[RC]").alias("wait"), F.concat(acc["out"], F.array(entry)).alias("out")))

    start = F.struct(F.lit(False).alias("wait"), F.array().cast("array<struct<path:string,state:string,old_path:string>>").alias("out"))
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def parse_commits(text: Column) -> Column:
    """array<struct<sha, parents, author_name, author_email, committer_time, subject, body>> from a log stream."""
    records = F.filter(F.transform(F.split(text, RECORD), lambda r: F.regexp_replace(r, r"^[\r\n]+", "")), lambda r: r != "")

    def of(r: Column) -> Column:
        head, rest = F.split(F.element_at(F.split(r, STACK), 1), UNIT), F.split(F.element_at(F.split(r, STACK), 2), UNIT)
        get = lambda a, k: F.get(a, F.lit(k))
        return F.struct(
            get(head, 0).alias("sha"), F.filter(F.split(F.coalesce(get(head, 1), F.lit("")), " "), lambda p: p != "").alias("parents"), get(head, 2).alias("author_name"),
            get(head, 3).alias("author_email"), get(head, 4).try_cast("long").alias("committer_time"), get(rest, 0).alias("subject"), F.coalesce(get(rest, 1), F.lit("")).alias("body"),
        )

    return F.transform(records, of)


def parse_name_status(text: Column) -> Column:
    """array<struct<status, pre_path, post_path, rename_score>> from lines of status, tab and one or two paths."""

    def of(line: Column) -> Column:
        p = F.split(line, "\t")
        code = F.element_at(p, 1)
        return F.struct(F.substring(code, 1, 1).alias("status"), F.element_at(p, 2).alias("pre_path"), F.element_at(p, -1).alias("post_path"), F.substr(code, F.lit(2), F.length(code)).try_cast("int").alias("rename_score"))

    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("\t"))), of)


def parse_tree(text: Column) -> Column:
    """array<struct<mode, type, sha, path>> from NUL-separated tree entries."""

    def of(item: Column) -> Column:
        head = F.split(F.substring_index(item, "\t", 1), " ")
        return F.struct(F.element_at(head, 1).alias("mode"), F.element_at(head, 2).alias("type"), F.element_at(head, 3).alias("sha"), F.substr(item, F.instr(item, "\t") + 1, F.length(item)).alias("path"))

    return F.transform(F.filter(F.split(text, "\x00"), lambda x: F.contains(x, F.lit("\t"))), of)


def is_regular(mode: Column) -> Column:
    return mode.isin("100644", "100755")


def mine(meta: DataFrame, files: DataFrame) -> DataFrame:
    """meta: one row a commit, files: sha and files. Commits with their files in order of time, then sha."""
    return meta.join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<status:string,pre_path:string,post_path:string,rename_score:int>>"))).orderBy("committer_time", "sha")
