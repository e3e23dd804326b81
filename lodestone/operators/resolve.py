"""Resolving imports, names, calls and parents between files: joins over ordered candidates, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import dir_name, source_of_test, to_posix
from lodestone.functions.text import words_in
from lodestone.operators.graph import file_node, symbol_node

#: What is tried behind a specifier, in this order.
CODE_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
SCRIPT_TWINS = [".ts", ".tsx"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.mjs", "index.json"]
RELATION = "source string, target string, kind string, provenance string, detail string"


def candidates(path: Column) -> Column:
    """The files that a normal path may mean, the most likely first."""
    stem = F.regexp_replace(path, r"\.(js|mjs|cjs)$", "")
    twins = F.when(stem != path, F.transform(words_in(*SCRIPT_TWINS), lambda e: F.concat(stem, e))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(path), F.transform(words_in(*CODE_EXTENSIONS), lambda e: F.concat(path, e)), twins, F.transform(words_in(*INDEX_FILES), lambda e: F.concat(path, F.lit("/"), e)))


def package_of(specifier: Column) -> Column:
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))


def first_file(wanted: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """wanted: key and ``tries`` (array). key, path: the first try that is a file, by an equi-join with the files."""
    tries = wanted.select(*key, F.posexplode("tries").alias("ord", "path"))
    return tries.join(files.select("path"), "path").groupBy(*key).agg(F.min_by("path", "ord").alias("path"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """imports: importer, specifier; files: path. importer, specifier, status, path, detail.

    RESOLVED has a path (detail ``alias`` if by one); EXTERNAL has the package in detail; UNRESOLVED why. An
    alias prefix that matches but leads nowhere never falls through to a package. Pairs are resolved once each."""
    d = imports.select("importer", "specifier").distinct()
    spec = F.col("specifier")
    empty = spec.isNull() | spec.isin("", "<dynamic>")
    alias, tries = F.lit(None).cast("string"), F.array().cast("array<string>")
    for prefix, targets in reversed(list(aliases)):
        bare = prefix[:-1]
        hit = spec.startswith(prefix) | (spec == bare)
        rest = F.when(spec == bare, "").otherwise(F.substr(spec, F.lit(len(prefix) + 1), F.length(spec)))
        own = F.flatten(F.array(*[candidates(to_posix(F.concat_ws("/", *([F.lit(t)] if t else []), F.when(rest != "", rest)))) for t in targets]))
        alias, tries = F.when(hit, F.lit(prefix)).otherwise(alias), F.when(hit, own).otherwise(tries)
    relative = spec.rlike(r"^[./]")
    joined = F.when(spec.startswith("/"), F.substr(spec, F.lit(2), F.length(spec))).otherwise(F.concat_ws("/", F.when(dir_name(F.col("importer")) != "", dir_name(F.col("importer"))), spec))
    d = d.withColumns({"alias": F.when(~empty, alias), "relative": relative & ~empty})
    d = d.withColumn("tries", F.when(F.col("alias").isNotNull(), tries).when(F.col("relative"), candidates(to_posix(joined))).otherwise(F.array().cast("array<string>")))
    found = first_file(d, files, ["importer", "specifier"])
    d = d.join(found, ["importer", "specifier"], "left")
    status = F.when(F.col("path").isNotNull(), "RESOLVED").when(empty | F.col("alias").isNotNull() | F.col("relative"), "UNRESOLVED").otherwise("EXTERNAL")
    why = F.when(empty, "dynamic or empty specifier").when(F.col("alias").isNotNull(), F.concat(F.lit("alias "), F.col("alias"), F.lit(" did not match any indexed file"))).otherwise(F.concat(F.lit('no indexed file for "'), spec, F.lit('"')))
    detail = F.when(status == "EXTERNAL", package_of(spec)).when(status == "UNRESOLVED", why).when(F.col("alias").isNotNull(), "alias")
    return d.select("importer", "specifier", status.alias("status"), "path", detail.alias("detail"))


def import_edges(resolved: DataFrame) -> DataFrame:
    target = F.when(F.col("status") == "RESOLVED", file_node(F.col("path"))).when(F.col("status") == "EXTERNAL", F.concat(F.lit("external:"), F.col("detail"))).otherwise(F.concat(F.lit("unresolved:"), F.coalesce("specifier", F.lit(""))))
    provenance = F.when(F.col("status") == "UNRESOLVED", "UNRESOLVED").otherwise("PARSED")
    return resolved.select(file_node(F.col("importer")).alias("source"), target.alias("target"), F.lit("imports").alias("kind"), provenance.alias("provenance"), F.col("specifier").alias("detail"))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def exported_symbols(symbols: DataFrame) -> DataFrame:
    """symbols: path, id, name, kind, export_kind. path, name, id of exported top-level symbols; a default export also under ``default``."""
    e = symbols.filter("export_kind is not null and kind not in ('heading', 'json-key')")
    own = e.select("path", "name", "id")
    default = e.filter("export_kind = 'default'").select("path", F.lit("default").alias("name"), "id")
    return own.unionByName(default).groupBy("path", "name").agg(F.min("id").alias("id"))


def reference_edges(names: DataFrame, exported: DataFrame, exports: DataFrame) -> DataFrame:
    """names: importer, path (resolved file), name. References to the exported symbol; an unresolved row
    only if the file exports neither the name nor everything (``*``). exports: path, name."""
    n = names.select("importer", "path", "name").distinct()
    hit = n.join(exported, ["path", "name"], "left")
    known = exports.select("path", "name").distinct()
    stars = known.filter("name = '*'").select("path").distinct()
    found = hit.filter("id is not null").select(file_node(F.col("importer")).alias("source"), symbol_node(F.col("id")).alias("target"), F.lit("references").alias("kind"), F.lit("PARSED").alias("provenance"), F.col("name").alias("detail"))
    lost = hit.filter("id is null and name <> '*'").join(known, ["path", "name"], "left_anti").join(stars, "path", "left_anti")
    lost = lost.select(file_node(F.col("importer")).alias("source"), F.concat(F.lit("unresolved:"), F.col("path"), F.lit("#"), F.col("name")).alias("target"), F.lit("references").alias("kind"), F.lit("UNRESOLVED").alias("provenance"), F.col("name").alias("detail"))
    return found.unionByName(lost)


def unique_exports(symbols: DataFrame) -> DataFrame:
    """name, path, id of the short names that exactly one file exports."""
    e = symbols.filter("export_kind is not null and kind not in ('heading', 'json-key')").withColumn("name", short_name(F.col("name")))
    return e.groupBy("name").agg(F.count_distinct("path").alias("n"), F.min(F.struct("path", "id")).alias("x")).filter("n = 1").select("name", "x.path", "x.id")


def resolve_names(uses: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """uses: path, name. Adds target_id and level: a local symbol of that short name, else what the file
    imports under it, else the only file that exports it (never the own one). imported: path, local, id."""
    local = symbols.filter("kind not in ('heading', 'json-key')").groupBy("path", short_name(F.col("name")).alias("name")).agg(F.min_by("id", F.struct("start_line", "id")).alias("local_id"))
    brought = imported.groupBy("path", F.col("local").alias("name")).agg(F.min("id").alias("imported_id"))
    lone = unique_exports(symbols).select("name", F.col("path").alias("lone_path"), F.col("id").alias("lone_id"))
    d = uses.join(local, ["path", "name"], "left").join(brought, ["path", "name"], "left").join(lone, "name", "left")
    alone = F.when(F.col("lone_path") != F.col("path"), F.col("lone_id"))
    level = F.when(F.col("local_id").isNotNull(), "local").when(F.col("imported_id").isNotNull(), "imported").when(alone.isNotNull(), "unique")
    return d.withColumns({"target_id": F.coalesce("local_id", "imported_id", alone), "level": level}).drop("local_id", "imported_id", "lone_path", "lone_id")


def call_edges(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """calls: path, caller_id (null at top level), callee. Only calls that resolve make an edge."""
    uses = calls.filter("caller_id is not null").select("path", "caller_id", short_name(F.col("callee")).alias("name")).distinct()
    d = resolve_names(uses, symbols, imported).filter("target_id is not null")
    provenance = F.when(F.col("level") == "unique", "STATIC_HEURISTIC").otherwise("PARSED")
    return d.select(symbol_node(F.col("caller_id")).alias("source"), symbol_node(F.col("target_id")).alias("target"), F.lit("calls").alias("kind"), provenance.alias("provenance"), F.col("name").alias("detail")).distinct()


def heritage_edges(heritages: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """heritages: path, symbol_id, kind (extends, implements), parent. A parent that nothing resolves keeps an unresolved edge."""
    d = resolve_names(heritages.withColumn("name", short_name(F.col("parent"))), symbols, imported)
    target = F.when(F.col("target_id").isNotNull(), symbol_node(F.col("target_id"))).otherwise(F.concat(F.lit("unresolved:"), F.col("parent")))
    provenance = F.when(F.col("target_id").isNull(), "UNRESOLVED").when(F.col("level") == "unique", "STATIC_HEURISTIC").otherwise("PARSED")
    return d.select(symbol_node(F.col("symbol_id")).alias("source"), target.alias("target"), "kind", provenance.alias("provenance"), F.col("parent").alias("detail")).distinct()


def test_edges(files: DataFrame) -> DataFrame:
    """files: path, is_test. A test file tests the file that its name names, if that is there."""
    t = files.filter("is_test").select("path", source_of_test(F.col("path")).alias("tested")).filter("tested is not null")
    known = files.select(F.col("path").alias("tested"))
    return t.join(known, "tested").select(file_node(F.col("path")).alias("source"), file_node(F.col("tested")).alias("target"), F.lit("tests").alias("kind"), F.lit("STATIC_HEURISTIC").alias("provenance"), F.lit(None).cast("string").alias("detail"))


def symbol_names(symbols: DataFrame) -> DataFrame:
    """canonical, symbol_id, name, kind, path, line: the full and the short form of every symbol that counts for exact hits."""
    from lodestone.functions.text import canonical_term

    counts = F.when(F.col("kind").isin("variable", "property"), F.col("export_kind").isNotNull()).otherwise(F.col("kind") != "json-key")
    keys = F.filter(F.array_distinct(F.array(canonical_term(F.col("name")), canonical_term(short_name(F.col("name"))))), lambda k: k != "")
    return symbols.filter(counts).select(F.explode(keys).alias("canonical"), F.col("id").alias("symbol_id"), "name", "kind", "path", F.col("start_line").alias("line"))


def search_symbols(names: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Symbols whose canonical form begins with the lower-cased prefix, in order of form, path and line."""
    return names.filter(F.col("canonical").startswith(prefix.lower())).orderBy("canonical", "path", "line", "symbol_id").limit(limit)


def match_frames(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames: trace_id, ord, path; files: path. trace_id, ord, path, file: the file itself, else the least file of
    which one path is the end of the other. Both sides are dealt by the base name."""
    from lodestone.functions.paths import base_name

    norm = to_posix(F.col("frame"))
    f = frames.select("trace_id", "ord", F.col("path").alias("frame")).withColumns({"norm": norm, "base": base_name(norm)})
    g = files.select(F.col("path").alias("file"), base_name(F.col("path")).alias("base"))
    ends = (F.col("norm") == F.col("file")) | F.col("norm").endswith(F.concat(F.lit("/"), F.col("file"))) | F.col("file").endswith(F.concat(F.lit("/"), F.col("norm")))
    hit = f.join(g, "base").filter(ends)
    return hit.groupBy("trace_id", "ord", F.col("frame").alias("path")).agg(F.min(F.struct((F.col("norm") != F.col("file")).alias("odd"), "file")).alias("x")).select("trace_id", "ord", "path", "x.file")


def alias_mapping(config_json: str, base_dir: str = "") -> list[tuple[str, list[str]]]:
    """Alias prefixes and their folders from a compiler configuration; stars are cut, the base is joined."""
    import json
    import posixpath

    from lodestone.operators.parse import relax_json

    try:
        options = json.loads(relax_json(config_json)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = posixpath.normpath(posixpath.join(base_dir, options.get("baseUrl", ".")))
    base = "" if base == "." else base
    return [(k.rstrip("*"), [posixpath.normpath(posixpath.join(base, t.rstrip("*"))).rstrip("/") for t in v]) for k, v in options.get("paths", {}).items() if isinstance(v, list)]
