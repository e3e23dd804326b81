"""Queries of the parsers and of resolution between files: over documents and events where they fit, else over small sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.paths import parser_of
from lodestone.operators import graph, parse, resolve
from lodestone.plans.base import DOCS, doc_texts, query, table
from lodestone.plans.inline import Inline
from lodestone.sources.shared import written

SOURCES = {
    "src/auth/session.ts": "import { Store, hash as digest } from './store';\nimport React from 'react';\nimport * as util from '../util';\n\n/** Keeps sessions. */\nexport class SessionStore extends Store implements Closable {\n  private ttl = 5;\n  open(id: string): string {\n    return digest(id);\n  }\n  close(): void {\n    util.log('closed {');\n    this.open('x');\n  }\n}\n\nexport const makeSession = (id: string) => {\n  return new SessionStore().open(id);\n};\n",
    "src/auth/store.ts": "export class Store {\n  get(key: string) {\n    return key;\n  }\n}\nexport function hash(x: string) {\n  return lonely(x);\n}\nexport interface Closable {\n  close(): void;\n}\nexport default hash;\n",
    "src/util.ts": "export function log(x: string) {\n  console.log(x);\n}\nexport enum Level { Low, High }\nexport type Id = string;\n",
    "src/lonely.ts": "export function lonely(x: string) { return x; }\n",
    "src/auth/session.test.ts": "import { makeSession, missing } from './session';\nconst lazy = import('./gone');\nmakeSession('a');\n",
    "conf/app.json": '{\n  // a remark\n  "name": "app",\n  "server": { "port": 80, "hosts": ["a", "b"] },\n}\n',
}


def sources(spark):
    return spark.createDataFrame(list(SOURCES.items()), "path string, text string")


def parsed(spark):
    return parse.parse_files(sources(spark))


def symbols(spark):
    s = parsed(spark).select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return s.filter("kind <> 'json-key'")


@query("p01_parser", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '[^/]\\.(ts|mts|cts|tsx|js|mjs|cjs|jsx)$') THEN 'script' WHEN regexp_matches(lower(url), '[^/]\\.(json|jsonc)$') THEN 'json' WHEN regexp_matches(lower(url), '[^/]\\.(md|markdown)$') THEN 'markdown' ELSE 'generic' END AS parser FROM pages")
def p01(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parser_of(F.col("url")).alias("parser"))


@query("p02_symbols", """SELECT * FROM (VALUES ('src/auth/session.ts', 'SessionStore', 'class', 6, 'named'), ('src/auth/session.ts', 'SessionStore.ttl', 'property', 7, NULL), ('src/auth/session.ts', 'SessionStore.open', 'method', 8, NULL), ('src/auth/session.ts', 'SessionStore.close', 'method', 11, NULL),
    ('src/auth/session.ts', 'makeSession', 'function', 17, 'named'), ('src/auth/store.ts', 'Store', 'class', 1, 'named'), ('src/auth/store.ts', 'Store.get', 'method', 2, NULL), ('src/auth/store.ts', 'hash', 'function', 6, 'named'), ('src/auth/store.ts', 'Closable', 'interface', 9, 'named'), ('src/auth/store.ts', 'Closable.close', 'method', 10, NULL),
    ('src/util.ts', 'log', 'function', 1, 'named'), ('src/util.ts', 'Level', 'enum', 4, 'named'), ('src/util.ts', 'Id', 'type', 5, 'named'), ('src/lonely.ts', 'lonely', 'function', 1, 'named')) t(path, name, kind, start_line, export_kind)""")
def p02(spark, sf_dir):
    return symbols(spark).select("path", "name", "kind", "start_line", "export_kind")


@query("p02_imports", """SELECT * FROM (VALUES ('src/auth/session.ts', './store', 'Store,hash', 'Store,digest'), ('src/auth/session.ts', 'react', 'default', 'React'), ('src/auth/session.ts', '../util', '*', 'util'), ('src/auth/session.test.ts', './session', 'makeSession,missing', 'makeSession,missing'), ('src/auth/session.test.ts', './gone', '', '')) t(path, specifier, names, locals)""")
def p02b(spark, sf_dir):
    return parsed(spark).select("path", F.explode("imports").alias("i")).select("path", "i.specifier", F.array_join("i.names", ",").alias("names"), F.array_join("i.locals", ",").alias("locals"))


@query("p03_json_keys", """SELECT * FROM (VALUES ('name', 3, 'name: string'), ('server', 4, 'server: object'), ('server.port', 4, 'server.port: number'), ('server.hosts', 4, 'server.hosts: array'), ('server.hosts.0', 1, 'server.hosts.0: string'), ('server.hosts.1', 1, 'server.hosts.1: string')) t(name, start_line, signature)""")
def p03(spark, sf_dir):
    return parsed(spark).filter("parser = 'json'").select(F.explode("symbols").alias("s")).select("s.name", "s.start_line", "s.signature")


@query("p03_event_props", "SELECT event_id, list_aggregate(list_sort(json_keys(props)), 'string_agg', ',') AS keys FROM events WHERE json_valid(props)")
def p03b(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.try_parse_json("props").isNotNull())
    return e.select("event_id", F.array_join(F.sort_array(F.json_object_keys("props")), ",").alias("keys"))


MD = f"""WITH {DOCS}, l AS (SELECT path, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM (SELECT path, regexp_split_to_array(text, '\\r?\\n') AS a FROM docs)),
    f AS (SELECT *, regexp_matches(content, '^\\s*```\\s*[A-Za-z0-9_+-]*\\s*$') AS fence, sum(CASE WHEN regexp_matches(content, '^\\s*```\\s*[A-Za-z0-9_+-]*\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS nf FROM l), o AS (SELECT * FROM f WHERE NOT fence AND nf % 2 = 0)"""


@query("p04_markdown_stats", f"{MD} SELECT path, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')))::BIGINT AS words, sum(len(regexp_extract_all(content, '\\[[^\\]]*\\]\\([^)]*\\)')))::BIGINT AS links FROM o GROUP BY path")
def p04(spark, sf_dir):
    return parse.markdown_stats(parse.markdown_lines(doc_texts(spark, sf_dir))).select("path", "words", "links")


HEADS = Inline("pg", "path string, text string", [("a.md", "# One\n## Two\n### Three\n## Four\n```\n# no\n```\n# Five #\n#### Six\n## Seven"), ("b.md", "### Low\n# Top\ntext\n###### Deep")])


@query("p04_headings", "SELECT * FROM (VALUES ('a.md', 1, 1, 'One', NULL), ('a.md', 2, 2, 'Two', 1), ('a.md', 3, 3, 'Three', 2), ('a.md', 4, 2, 'Four', 1), ('a.md', 8, 1, 'Five', NULL), ('a.md', 9, 4, 'Six', 8), ('a.md', 10, 2, 'Seven', 8), ('b.md', 1, 3, 'Low', NULL), ('b.md', 2, 1, 'Top', NULL), ('b.md', 4, 6, 'Deep', 2)) t(path, line, level, title, parent_line)")
def p04b(spark, sf_dir):
    return parse.headings(parse.markdown_lines(HEADS.df(spark))).select("path", "line", "level", "title", "parent_line")


TRACES = Inline("tr", "trace_id int, text string", [(1, "Error: no\n    at run (/app/src/a.ts:10:5)\n    at node:internal/x.js:1:1\n    at /app/src/b.js:7"), (2, 'Traceback\n  File "/app/m.py", line 12\n  File "/app/m.py", line 12\n  File "<stdin>", line 1'), (3, "\tat com.x.Main.go(Main.java:33)\n\tmain.go:9")])


@query("p06_stack_frames", "SELECT * FROM (VALUES (1, 1, '/app/src/a.ts', 10, 'file-line-col'), (1, 2, '/app/src/b.js', 7, 'file-line-col'), (2, 1, '/app/m.py', 12, 'python'), (3, 1, 'Main.java', 33, 'java'), (3, 2, 'main.go', 9, 'file-line-col')) t(trace_id, ord, path, line, source)")
def p06(spark, sf_dir):
    return parse.stack_frames(TRACES.df(spark))


@query("j18_frames_to_files", "SELECT * FROM (VALUES (1, 1, '/app/src/a.ts', 'src/a.ts'), (1, 2, '/app/src/b.js', 'lib/app/src/b.js'), (3, 2, 'main.go', 'main.go')) t(trace_id, ord, path, file)")
def j18(spark, sf_dir):
    files = spark.createDataFrame([("src/a.ts",), ("x/main.go",), ("main.go",), ("lib/app/src/b.js",), ("other/b.js",)], "path string")
    return resolve.match_frames(parse.stack_frames(TRACES.df(spark)), files)


def resolved(spark):
    i = parsed(spark).select(F.col("path").alias("importer"), F.explode("imports").alias("i")).select("importer", "i.specifier", "i.names", "i.locals")
    return i, resolve.resolve_imports(i, sources(spark).select("path"))


def imported(spark):
    """path, local, id of what files import, and the names behind it: importer, path, name."""
    i, r = resolved(spark)
    flat = i.withColumn("z", F.explode(F.arrays_zip("names", "locals"))).select("importer", "specifier", F.col("z.names").alias("name"), F.col("z.locals").alias("local"))
    wanted = flat.join(r.filter("status = 'RESOLVED'").select("importer", "specifier", "path"), ["importer", "specifier"])
    ids = wanted.join(resolve.exported_symbols(symbols(spark)), ["path", "name"])
    return ids.select(F.col("importer").alias("path"), "local", "id"), wanted.select("importer", "path", "name")


@query("j04_references", "SELECT * FROM (VALUES ('file:src/auth/session.ts', 'symbol:src/auth/store.ts#Store@class:1', 'PARSED'), ('file:src/auth/session.ts', 'symbol:src/auth/store.ts#hash@function:6', 'PARSED'), ('file:src/auth/session.test.ts', 'symbol:src/auth/session.ts#makeSession@function:17', 'PARSED'), ('file:src/auth/session.test.ts', 'unresolved:src/auth/session.ts#missing', 'UNRESOLVED')) t(source, target, provenance)")
def j04(spark, sf_dir):
    exports = parsed(spark).select("path", F.explode("exports").alias("name"))
    return resolve.reference_edges(imported(spark)[1], resolve.exported_symbols(symbols(spark)), exports).select("source", "target", "provenance")


@query("j05_calls", """SELECT * FROM (VALUES ('symbol:src/auth/session.ts#SessionStore.open@method:8', 'symbol:src/auth/store.ts#hash@function:6', 'PARSED'), ('symbol:src/auth/session.ts#SessionStore.close@method:11', 'symbol:src/util.ts#log@function:1', 'STATIC_HEURISTIC'), ('symbol:src/auth/session.ts#SessionStore.close@method:11', 'symbol:src/auth/session.ts#SessionStore.open@method:8', 'PARSED'),
    ('symbol:src/auth/session.ts#makeSession@function:17', 'symbol:src/auth/session.ts#SessionStore.open@method:8', 'PARSED'), ('symbol:src/auth/session.ts#makeSession@function:17', 'symbol:src/auth/session.ts#SessionStore@class:6', 'PARSED'), ('symbol:src/auth/store.ts#hash@function:6', 'symbol:src/lonely.ts#lonely@function:1', 'STATIC_HEURISTIC'), ('symbol:src/util.ts#log@function:1', 'symbol:src/util.ts#log@function:1', 'PARSED')) t(source, target, provenance)""")
def j05(spark, sf_dir):
    calls = parsed(spark).select("path", F.explode("calls").alias("c")).select("path", "c.caller_id", "c.callee")
    return resolve.call_edges(calls, symbols(spark), imported(spark)[0]).select("source", "target", "provenance")


@query("j06_heritage", "SELECT * FROM (VALUES ('extends', 'symbol:src/auth/store.ts#Store@class:1', 'PARSED'), ('implements', 'symbol:src/auth/store.ts#Closable@interface:9', 'STATIC_HEURISTIC')) t(kind, target, provenance)")
def j06(spark, sf_dir):
    h = parsed(spark).select("path", F.explode("heritages").alias("h")).select("path", "h.symbol_id", "h.kind", "h.parent")
    return resolve.heritage_edges(h, symbols(spark), imported(spark)[0]).select("kind", "target", "provenance")


@query("j07_tests", "SELECT 'file:src/auth/session.test.ts' AS source, 'file:src/auth/session.ts' AS target")
def j07(spark, sf_dir):
    from lodestone.functions.paths import is_test_file

    return resolve.test_edges(sources(spark).select("path", is_test_file(F.col("path")).alias("is_test"))).select("source", "target")


@query("j08_unique_exports", "SELECT p_name || ' ' || p_brand AS name, min('f' || p_size) AS path FROM part GROUP BY p_name || ' ' || p_brand HAVING count(DISTINCT p_size) = 1")
def j08(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_size").alias("path"), F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" "), "p_brand").alias("name"), F.lit("function").alias("kind"), F.lit("named").alias("export_kind"))
    return resolve.unique_exports(s).select("name", "path")


@query("j11_exact_hits", "SELECT * FROM (VALUES ('open', 'SessionStore.open', 8), ('sessionstore', 'SessionStore', 6), ('lonely', 'lonely', 1)) t(canonical, name, line)")
def j11(spark, sf_dir):
    wanted = spark.createDataFrame([("open",), ("sessionstore",), ("lonely",), ("ttl",)], "canonical string")
    return wanted.join(resolve.symbol_names(symbols(spark)), "canonical").select("canonical", "name", "line")


def edges(spark):
    """All edges of the small sources, written once."""
    _, r = resolved(spark)
    brought, wanted = imported(spark)
    p = written(parsed(spark), "parsed")
    s = symbols(spark)
    calls = p.select("path", F.explode("calls").alias("c")).select("path", "c.caller_id", "c.callee")
    heritage = p.select("path", F.explode("heritages").alias("h")).select("path", "h.symbol_id", "h.kind", "h.parent")
    exports = p.select("path", F.explode("exports").alias("name"))
    from lodestone.functions.paths import is_test_file

    rel = resolve.import_edges(r)
    for more in (resolve.reference_edges(wanted, resolve.exported_symbols(s), exports), resolve.call_edges(calls, s, brought), resolve.heritage_edges(heritage, s, brought), resolve.test_edges(sources(spark).select("path", is_test_file(F.col("path")).alias("is_test")))):
        rel = rel.unionByName(more)
    files = p.select("path", F.transform("symbols", lambda x: F.struct(x["id"].alias("id"))).alias("symbols"))
    return written(graph.derive_edges(files, rel), "edges")


@query("g06_symbol_walk", "SELECT * FROM (VALUES ('src/auth/session.ts', 0), ('src/auth/session.test.ts', 1), ('src/auth/store.ts', 1), ('src/util.ts', 1)) t(path, depth)")
def g06(spark, sf_dir):
    """Walks start at file nodes and cross files only; symbols of other files are met through references."""
    starts = spark.createDataFrame([(0, "file:src/auth/session.ts")], "query_id int, node string")
    seen, _ = graph.traverse(edges(spark), starts, 1, both_ways=True, accept=graph.crosses_files())
    return seen.select(graph.file_of_node(F.col("node")).alias("path"), "depth").groupBy("path").agg(F.min("depth").alias("depth"))


@query("p07_blanked_parse", "SELECT 'a.ts' AS path, 1::BIGINT AS n_symbols, false AS leaks")
def p07(spark, sf_dir):
    """Parsing of a text whose secrets were blanked first: nothing of them is left in any field."""
    from lodestone.operators import security

    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    text = f"export function load() {{ return '{key}'; }}\n"
    d = spark.createDataFrame([("a.ts", security.blank_spans(text, [(s, e) for _, s, e, *_ in security.spans(text)]))], "path string, text string")
    p = parse.parse_files(d)
    return p.select("path", F.size("symbols").cast("long").alias("n_symbols"), F.contains(F.to_json(F.struct("symbols", "calls", "imports")), F.lit(key)).alias("leaks"))


@query("p08_import_policy", "SELECT * FROM (VALUES ('src/auth/session.ts', 'react')) t(path, specifier)")
def p08(spark, sf_dir):
    allowed = spark.createDataFrame([("./store",), ("../util",), ("./session",), ("./gone",)], "specifier string")
    i = parsed(spark).select("path", F.explode("imports").alias("i")).select("path", "i.specifier")
    return i.join(allowed, "specifier", "left_anti").select("path", "specifier")


@query("p09_summary", "SELECT * FROM (VALUES ('Guide', 'sh,ts', 'Guide | code: sh,ts'), ('Guide', '', 'Guide'), (NULL, 'sh', 'code: sh')) t(summary, languages, merged)")
def p09(spark, sf_dir):
    d = spark.createDataFrame([("Guide", "sh,ts"), ("Guide", ""), (None, "sh")], "summary string, languages string")
    return d.withColumn("merged", parse.summary_with_code(F.col("summary"), F.col("languages")))


@query("t14_relaxed_json", """SELECT * FROM (VALUES ('{"a": 1, "u": "http://x,}"}'), ('{"a": [1, 2]}')) t(json)""")
def t14(spark, sf_dir):
    import json

    texts = ['{"a": 1, // one\n "u": "http://x,}",}', '{"a": [1, 2, /* x */ ], }']
    return spark.createDataFrame([(json.dumps(json.loads(parse.relax_json(t))),) for t in texts], "json string")


@query("s31_alias_config", "SELECT * FROM (VALUES ('@/', 'src'), ('~lib/', 'src/lib'), ('~lib/', 'vendor')) t(prefix, target)")
def s31(spark, sf_dir):
    text = '{ // c\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], "~lib/*": ["src/lib/*", "vendor/*"], } } }'
    rows = [(p, t) for p, ts in resolve.alias_mapping(text) for t in ts]
    return spark.createDataFrame(rows, "prefix string, target string")
