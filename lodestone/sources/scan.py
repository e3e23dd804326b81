"""Scanning a tree of text files into rows, and the ignore rules that decide what a scan sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.paths import detect_language, glob_regex, has_traversal, is_test_file

MAX_BYTES = 1 << 20
PATTERN_SCHEMA = "ordinal int, raw string, source_dir string, regex string, negated boolean, dir_only boolean, builtin boolean"


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (relative to the root), length, content of every file below ``root``. Files above ``max_bytes``
    come without content: the reader gets the limit as a filter and never opens them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.regexp_replace(F.col("path"), "^" + _quoted(base) + "/+", "")
    small = files.filter(F.col("length") <= max_bytes).select(path.alias("path"), "length", "content")
    large = files.filter(F.col("length") > max_bytes).select(path.alias("path"), "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8,192 bytes, or over a tenth control characters among the first 1,024. Bytes are looked at
    one by one, so any bytes will do."""
    probe = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    sample = F.substring(probe, 1, 1024)
    odd = F.length(sample) - F.length(F.regexp_replace(sample, r"[\x00-\x08\x0E-\x1F]", ""))
    return F.contains(probe, F.lit("\x00")) | ((F.length(sample) > 0) & (odd > 0.1 * F.length(sample)))


def count_lines(text: Column) -> Column:
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def scan(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files: path, length, content (binary). path, language, size_bytes, line_count, content_hash, is_test,
    status and text; skipped files have no text. In the text of others bytes that are not UTF-8 become U+FFFD, the hash is
    that of the bytes. Paths that climb out of the root are left out."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    status = F.when(F.col("length") > max_bytes, "SKIPPED_TOO_LARGE").when(looks_binary(F.col("content")), "SKIPPED_BINARY").otherwise("OK")
    d = files.filter(~has_traversal(F.col("path"))).withColumns({"status": status})
    ok = F.col("status") == "OK"
    return d.select(
        "path", detect_language(F.col("path")).alias("language"), F.col("length").cast("long").alias("size_bytes"),
        F.when(ok, count_lines(text)).alias("line_count"), F.when(ok, F.sha2("content", 256)).alias("content_hash"), is_test_file(F.col("path")).alias("is_test"), "status",
        F.when(ok, text).alias("text"),
    )


def parse_patterns(lines: list[str], source_dir: str = "", builtin: bool = False, first: int = 0) -> list[tuple]:
    """Rows of PATTERN_SCHEMA from the lines of an ignore file in ``source_dir``."""
    out = []
    for k, line in enumerate(lines):
        raw = line.strip()
        if not raw or raw.startswith("#"):
            continue
        body = raw.removeprefix("!")
        folder = body.endswith("/")
        body = body.removesuffix("/")
        out.append((first + k, raw, source_dir.replace("\\", "/").rstrip("/"), glob_regex(body.removeprefix("/"), "/" in body), raw.startswith("!"), folder, builtin))
    return out


def builtin_patterns() -> list[tuple]:
    return parse_patterns(config.DEFAULT_EXCLUDES, builtin=True, first=1_000_000)


def ignore_patterns(spark: SparkSession, patterns: list[tuple]) -> DataFrame:
    return spark.createDataFrame(patterns, PATTERN_SCHEMA)


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def excluded(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """paths: path. path, excluded. Of the patterns that match the last decides, but built-in ones always
    hold, and a file in an excluded folder is excluded whatever follows.

    A pattern meets only the paths below its folder: both sides are joined on that folder."""
    nodes = paths.select("path", F.explode(F.concat(F.transform(ancestors(F.col("path")), lambda a: F.struct(a.alias("node"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("path").alias("node"), F.lit(False).alias("is_dir"))))).alias("n")).select("path", "n.node", "n.is_dir")
    scoped = nodes.withColumn("source_dir", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("node")))))
    below = F.when(F.col("source_dir") == "", F.col("node")).otherwise(F.substr("node", F.length("source_dir") + 2, F.length("node")))
    met = scoped.join(patterns, "source_dir").withColumn("below", below)
    hit = F.when(F.col("dir_only") & ~F.col("is_dir"), F.exists(ancestors(F.col("below")), lambda a: F.rlike(a, F.col("regex")))).otherwise(F.rlike(F.col("below"), F.col("regex")))
    hits = met.filter(hit).groupBy("path", "node").agg(F.max_by("negated", F.when(~F.col("builtin"), F.col("ordinal"))).alias("negated"), F.bool_or("builtin").alias("fixed"))
    out = hits.groupBy("path").agg(F.bool_or(F.col("fixed") | ~F.coalesce("negated", F.lit(True))).alias("excluded"))
    return paths.select("path").join(out, "path", "left").select("path", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def synthetic_tree(spark: SparkSession, modules: int, files: int = 10) -> DataFrame:
    """path, text of an invented code base: ``files`` files a module, each importing the one before."""
    d = spark.range(modules * files).select((F.col("id") / files).cast("long").alias("m"), (F.col("id") % files).alias("f"))
    path = F.concat(F.lit("src/module"), F.col("m"), F.lit("/file"), F.col("f"), F.lit(".ts"))
    imp = F.when(F.col("f") > 0, F.concat(F.lit("import { fn"), F.col("f") - 1, F.lit(" } from './file"), F.col("f") - 1, F.lit("';\n"))).otherwise("")
    return d.select(path.alias("path"), F.concat(imp, F.lit("export function fn"), F.col("f"), F.lit("(x: number): number {\n  return x + "), F.col("m"), F.lit(";\n}\n")).alias("text"))
