"""The typed relationship graph as a table of edges (source, target, kind, provenance, detail), and walks on it.

Node ids carry their namespace: ``file:``, ``dir:``, ``symbol:``, ``external:``, ``unresolved:``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import RETRIEVAL, Retrieval
from lodestone.functions.paths import dir_name
from lodestone.sources.shared import written

EDGE = ["source", "target", "kind", "provenance", "detail"]


def file_node(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_node(symbol_id: Column) -> Column:
    return F.concat(F.lit("symbol:"), symbol_id)


def symbol_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat(path, F.lit("#"), name, F.lit("@"), kind, F.lit(":"), line.cast("string"))


def file_of_node(node: Column) -> Column:
    """The file that a node belongs to; null for folders, packages and unresolved names."""
    return F.when(node.startswith("file:"), F.substr(node, F.lit(6), F.length(node))).when(node.startswith("symbol:"), F.regexp_extract(node, r"^symbol:([^#]*)#", 1))


def derive_edges(entries: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """entries: path, symbols (with id). Folder contains file, file contains symbol, and the relations."""
    fixed = [F.lit("contains").alias("kind"), F.lit("PARSED").alias("provenance"), F.lit(None).cast("string").alias("detail")]
    folders = entries.select(F.concat(F.lit("dir:"), dir_name(F.col("path"))).alias("source"), file_node(F.col("path")).alias("target"), *fixed)
    symbols = entries.select("path", F.explode("symbols").alias("s")).select(file_node(F.col("path")).alias("source"), symbol_node(F.col("s.id")).alias("target"), *fixed)
    out = folders.unionByName(symbols)
    return unique_edges(out.unionByName(relations.select(*EDGE)) if relations is not None else out)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target and kind (the least of the rest, so that the result is the same each time)."""
    return edges.groupBy("source", "target", "kind").agg(F.min(F.struct("provenance", "detail")).alias("x")).select("source", "target", "kind", "x.provenance", "x.detail")


def file_dependencies(edges: DataFrame) -> DataFrame:
    """path, other: distinct files that a file's own node points to."""
    e = edges.filter(F.col("source").startswith("file:") & F.col("target").startswith("file:"))
    return e.select(file_of_node(F.col("source")).alias("path"), file_of_node(F.col("target")).alias("other")).distinct()


def hubs(edges: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """path, degree of the files (path, is_test) with the most distinct neighbours, both ways; tests and lonely files don't count."""
    deps = file_dependencies(edges)
    both = deps.groupBy("path").agg(F.count("*").alias("n")).unionByName(deps.groupBy(F.col("other").alias("path")).agg(F.count("*").alias("n")))
    degree = both.groupBy("path").agg(F.sum("n").alias("degree"))
    return files.filter(~F.col("is_test")).select("path").join(degree, "path").orderBy(F.desc("degree"), "path").limit(limit)


def replace_file_edges(edges: DataFrame, changed: DataFrame, fresh: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges after a change. changed: path of files changed or removed; fresh: their new outgoing edges;
    symbols: the symbol nodes that exist afterwards. An edge to a symbol that is gone goes too; it is never turned to another."""
    owned = file_of_node(F.col("source"))
    kept = edges.withColumn("path", F.coalesce(owned, file_of_node(F.col("target")))).join(changed.select("path").distinct(), "path", "left_anti").select(*EDGE)
    both = unique_edges(kept.unionByName(fresh.select(*EDGE)))
    to_symbol = both.filter(F.col("target").startswith("symbol:")).join(symbols.select(F.col("node").alias("target")), "target", "left_semi")
    return both.filter(~F.col("target").startswith("symbol:")).unionByName(to_symbol.select(*both.columns))


#: Nodes up to which a frontier or the nodes walked from go to every task (some 100 MB).
MAX_NODES = 500_000


def _sent(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= MAX_NODES else nodes  # counted; then the edges stay where they lie


def traverse(edges: DataFrame, starts: DataFrame, depth: int, both_ways: bool = False, accept: Column | None = None, unique: bool = False, nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Walks breadth first from many starts at once. starts: query_id, node. Returns
    (query_id, node, depth) with the least depth, and (query_id, *edge) of the edges walked, each once in
    its stored direction. Every level is one join of the new frontier with the edges; edges and levels are written
    out, so plans don't nest and edges are made once. unique: no two edges are the same, or the caller takes them as one, so none need be
    looked for. nodes: whether the nodes are wanted; else those of the last level, which no edge is walked from, are not looked for."""
    usable = edges.filter(accept) if accept is not None else edges
    usable = written(usable if unique else usable.distinct(), "edges")
    arcs = usable.select("source", "target").withColumnRenamed("source", "node")
    if both_ways:
        arcs = arcs.unionByName(usable.select(F.col("target").alias("node"), F.col("source").alias("target")))
    frontier = written(starts.select("query_id", "node").distinct().withColumn("depth", F.lit(0)), "walk")
    seen = frontier
    for level in range(1, depth + (1 if nodes else 0)):
        reached = arcs.join(_sent(frontier.select("query_id", "node")), "node").select("query_id", F.col("target").alias("node")).distinct()
        frontier = written(reached.join(seen, ["query_id", "node"], "left_anti").withColumn("depth", F.lit(level)), "walk")
        seen = seen.unionByName(frontier)
        if level < depth and frontier.isEmpty():
            break
    # The queries of each node, so that an edge meets its two ends' and is given once for each of them.
    inner = seen.filter(F.col("depth") < depth).groupBy("node").agg(F.collect_set("query_id").alias("_by"))
    inner = _sent(written(inner, "inner"))
    walked = usable.join(inner.withColumnsRenamed({"node": "source", "_by": "_from"}), "source", "left")
    by = F.coalesce("_from", F.array())
    if both_ways:
        walked = walked.join(inner.withColumnsRenamed({"node": "target", "_by": "_into"}), "target", "left")
        by = F.array_union(by, F.coalesce("_into", F.array()))
    return seen, walked.select(F.explode(by).alias("query_id"), *edges.columns)


def crosses_files() -> Column:
    a, b = file_of_node(F.col("source")), file_of_node(F.col("target"))
    return F.coalesce(a != b, F.lit(False))


def structural_signals(walked: DataFrame, cfg: Retrieval = RETRIEVAL) -> DataFrame:
    """query_id, path, kind, other, weight from walked edges: at most one for each kind and counterpart, none to oneself."""
    a, b = file_of_node(F.col("source")).alias("a"), file_of_node(F.col("target")).alias("b")
    e = walked.select("query_id", "kind", a, b).filter("a is not null and b is not null and a <> b")
    # Kinds that tell the same are one before anything is told, and so are calls there and back.
    x, y, kind = F.col("a"), F.col("b"), F.col("kind")
    told = F.when(kind.isin("imports", "references"), "imports").when(kind.isin("extends", "implements"), "extends").when(kind.isin("calls", "tests"), kind)
    turned = (told == "calls") & (x > y)
    e = e.select("query_id", told.alias("kind"), F.when(turned, y).otherwise(x).alias("a"), F.when(turned, x).otherwise(y).alias("b")).filter("kind is not null").distinct()
    signal = lambda at, kind, other, w: F.struct(at.alias("path"), F.lit(kind).alias("kind"), other.alias("other"), F.lit(w).alias("weight"))
    made = (
        F.when(kind == "imports", F.array(signal(x, "DIRECT_DEPENDENT", y, cfg.dependent), signal(y, "DIRECT_DEPENDENCY", x, cfg.dependency)))
        .when(kind == "calls", F.array(signal(x, "CALL_EDGE", y, cfg.call), signal(y, "CALL_EDGE", x, cfg.call)))
        .when(kind == "tests", F.array(signal(x, "TEST_OF", y, cfg.test_of)))
        .otherwise(F.array(signal(x, "INHERITANCE", y, cfg.inheritance)))
    )
    return e.select("query_id", F.explode(made).alias("s")).select("query_id", "s.*")


def capped(signals: DataFrame, cap: float = RETRIEVAL.structural_cap) -> DataFrame:
    """Scales each path's signals so that they sum to ``cap`` at most, which damps hubs."""
    total = signals.groupBy("query_id", "path").agg(F.sum("weight").alias("total"))
    scale = F.when(F.col("total") > cap, cap / F.col("total")).otherwise(1.0)
    return signals.join(total, ["query_id", "path"]).withColumn("weight", F.col("weight") * scale).drop("total")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: query_id, path. query_id, path, seed: files one hop away, either way, each once for a seed."""
    deps = file_dependencies(edges)
    both = deps.unionByName(deps.select(F.col("other").alias("path"), F.col("path").alias("other"))).distinct()
    s = seeds.select("query_id", F.col("path").alias("seed")).distinct()
    return s.join(both, s["seed"] == both["path"]).select("query_id", F.col("other").alias("path"), "seed").distinct()


def affected(entries_edges: DataFrame, resolved: DataFrame, names: DataFrame, changed: DataFrame) -> DataFrame:
    """path of files whose relations must be made anew: an edge of theirs led into a changed file, an import
    now resolves into one, or a call or parent bears a name of one. resolved: path, target; names: path, name; changed: path, name (nullable)."""
    files = changed.select(F.col("path").alias("target")).distinct()
    led = entries_edges.select(file_of_node(F.col("source")).alias("path"), file_of_node(F.col("target")).alias("target")).join(files, "target", "left_semi").select("path")
    into = resolved.join(files, "target", "left_semi").select("path")
    named = names.join(changed.filter("name is not null").select("name").distinct(), "name", "left_semi").select("path")
    return led.unionByName(into).unionByName(named).unionByName(changed.select("path")).filter("path is not null").distinct()
