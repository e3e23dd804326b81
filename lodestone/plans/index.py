"""One index run: scan, parse, resolve, and the edges and entries that come of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import detect_language, is_test_file
from lodestone.functions.text import extract_identifiers
from lodestone.operators import graph, parse, resolve
from lodestone.sources.shared import written


def index_run(files: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> tuple[DataFrame, DataFrame]:
    """files: path, text. (entries, edges): entries hold what retrieval and packing need of each file."""
    p = written(parse.parse_files(files), "parsed")
    md = parse.headings(parse.markdown_lines(files.filter(detect_language(F.col("path")) == "markdown")))
    own = p.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    heads = md.select("path", graph.symbol_id(F.col("path"), F.col("title"), F.lit("heading"), F.col("line")).alias("id"), F.col("title").alias("name"), F.lit("heading").alias("kind"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title").alias("signature"), F.lit(None).cast("string").alias("export_kind"), F.lit(None).cast("string").alias("parent_id"))
    symbols = written(own.unionByName(heads), "symbols")
    known = files.select("path")
    imports = p.select(F.col("path").alias("importer"), F.explode("imports").alias("i")).select("importer", "i.specifier", "i.names", "i.locals")
    resolved = written(resolve.resolve_imports(imports, known, aliases), "resolved")
    flat = imports.withColumn("z", F.explode(F.arrays_zip("names", "locals"))).select("importer", "specifier", F.col("z.names").alias("name"), F.col("z.locals").alias("local"))
    wanted = flat.join(resolved.filter("status = 'RESOLVED'").select("importer", "specifier", "path"), ["importer", "specifier"])
    exported = resolve.exported_symbols(symbols)
    brought = wanted.join(exported, ["path", "name"]).select(F.col("importer").alias("path"), "local", "id")
    calls = p.select("path", F.explode("calls").alias("c")).select("path", "c.caller_id", "c.callee")
    heritage = p.select("path", F.explode("heritages").alias("h")).select("path", "h.symbol_id", "h.kind", "h.parent")
    relations = resolve.import_edges(resolved)
    for more in (
        resolve.reference_edges(wanted.select("importer", "path", "name"), exported, p.select("path", F.explode("exports").alias("name"))),
        resolve.call_edges(calls, symbols, brought),
        resolve.heritage_edges(heritage, symbols, brought),
        resolve.test_edges(files.select("path", is_test_file(F.col("path")).alias("is_test"))),
    ):
        relations = relations.unionByName(more)
    per = symbols.groupBy("path").agg(F.collect_list(F.struct("id", "name", "kind", "start_line", "end_line", "signature", "export_kind", "parent_id")).alias("symbol_rows"))
    io = p.select("path", F.concat(F.flatten(F.transform("imports", lambda i: i["names"])), "exports").alias("io"), "summary")
    none = F.array().cast("array<string>")
    d = files.join(per, "path", "left").join(io, "path", "left")
    entries = d.select(
        "path", detect_language(F.col("path")).alias("language"), F.sha2("text", 256).alias("content_hash"), is_test_file(F.col("path")).alias("is_test"), "symbol_rows",
        F.coalesce(F.transform("symbol_rows", lambda s: s["name"]), none).alias("symbols"), F.coalesce("io", none).alias("io"), "summary", extract_identifiers(F.col("text")).alias("identifiers"), "text",
    )
    entries = written(entries, "entries")
    edges = graph.derive_edges(entries.select("path", F.coalesce("symbol_rows", F.array().cast(dict(entries.dtypes)["symbol_rows"])).alias("symbols")), relations)
    return entries, written(edges, "edges")
