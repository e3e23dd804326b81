"""Queries of the graph: walks over the foreign keys of the star schema, and the page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.paths import is_entry_point
from lodestone.operators import graph, tree
from lodestone.operators.resolve import first_file, package_of, resolve_imports
from lodestone.plans.base import DOCS, doc_texts, listed, query, table
from lodestone.plans.inline import Inline
from lodestone.plans.retrieve import project_ranking
from lodestone.sources.shared import written

FK = """fk AS (SELECT 'file:r' || n_regionkey AS source, 'file:n' || n_nationkey AS target, 'imports' AS kind FROM nation UNION ALL SELECT 'file:n' || s_nationkey, 'file:s' || s_suppkey, 'calls' FROM supplier
    UNION ALL SELECT DISTINCT 'file:s' || l_suppkey, 'file:p' || l_partkey, 'references' FROM lineitem)"""


def fk_edges(spark, sf_dir, unique=False, repeated=False):
    """unique: nations and suppliers that are told twice count once. repeated: edges may be told twice, as the rows tell them."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edge = lambda d, a, x, b, y, kind: d.select(F.concat(F.lit(f"file:{a}"), F.col(x)).alias("source"), F.concat(F.lit(f"file:{b}"), F.col(y)).alias("target"), F.lit(kind).alias("kind"), F.lit("PARSED").alias("provenance"), F.lit(None).cast("string").alias("detail"))
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    li = edge(pairs if repeated else pairs.distinct(), "s", "l_suppkey", "p", "l_partkey", "references")
    few = [edge(n, "r", "n_regionkey", "n", "n_nationkey", "imports"), edge(s, "n", "s_nationkey", "s", "s_suppkey", "calls")]
    few = [d.distinct() for d in few] if unique else few
    return few[0].unionByName(few[1]).unionByName(li)


def starts(spark, *nodes):
    return spark.createDataFrame([(k, n) for k, n in enumerate(nodes)], "query_id int, node string")


@query("g01_derive_edges", f"WITH {DOCS} SELECT 'dir:' || regexp_replace(path, '/?[^/]*$', '') AS source, 'file:' || path AS target, 'contains' AS kind FROM docs UNION ALL SELECT 'file:' || path, 'symbol:' || path || '#x@heading:1', 'contains' FROM docs")
def g01(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    e = d.select("path", F.array(F.struct(graph.symbol_id(F.col("path"), F.lit("x"), F.lit("heading"), F.lit(1)).alias("id"))).alias("symbols"))
    return graph.derive_edges(e).select("source", "target", "kind")


@query("g02_dependencies", f"WITH {FK} SELECT DISTINCT substr(source, 6) AS path, substr(target, 6) AS other FROM fk")
def g02(spark, sf_dir):
    return graph.file_dependencies(fk_edges(spark, sf_dir))


@query("g03_replace_edges", f"WITH {FK}, gone AS (SELECT 's' || s_suppkey AS path FROM supplier WHERE s_suppkey % 5 = 1) SELECT source, target, kind FROM fk WHERE substr(source, 6) NOT IN (SELECT path FROM gone) UNION SELECT 'file:' || path, 'file:new', 'imports' FROM gone")
def g03(spark, sf_dir):
    changed = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("path"))
    fresh = changed.select(graph.file_node(F.col("path")).alias("source"), F.lit("file:new").alias("target"), F.lit("imports").alias("kind"), F.lit("PARSED").alias("provenance"), F.lit(None).cast("string").alias("detail"))
    none = spark.createDataFrame([], "node string")
    return graph.replace_file_edges(fk_edges(spark, sf_dir), changed, fresh, none).select("source", "target", "kind")


def _walk(depth: int, both: bool) -> str:
    arcs = "arcs AS (SELECT source AS a, target AS b FROM fk" + (" UNION SELECT target, source FROM fk)" if both else ")")
    return f"WITH RECURSIVE {FK}, {arcs}, st(query_id, node) AS (VALUES (0, 'file:r0'), (1, 'file:r2')), walk(query_id, node, depth) AS (SELECT query_id, node, 0 FROM st UNION SELECT query_id, b, depth + 1 FROM walk JOIN arcs ON a = node WHERE depth < {depth}), seen AS (SELECT query_id, node, min(depth) AS depth FROM walk GROUP BY ALL)"


@query("g04_traverse", _walk(3, False) + " SELECT query_id, node, depth::INTEGER AS depth FROM seen")
def g04(spark, sf_dir):
    return graph.traverse(fk_edges(spark, sf_dir, True), starts(spark, "file:r0", "file:r2"), 3, unique=True)[0]


@query("g05_both_ways", _walk(2, True) + " SELECT DISTINCT query_id, source, target, kind FROM seen JOIN fk ON (node = source OR node = target) WHERE depth < 2")
def g05(spark, sf_dir):
    return graph.traverse(fk_edges(spark, sf_dir, True), starts(spark, "file:r0", "file:r2"), 2, both_ways=True, unique=True)[1].select("query_id", "source", "target", "kind")


SIGNALS = _walk(3, True) + """, w AS (SELECT DISTINCT query_id, substr(source, 6) AS a, substr(target, 6) AS b, kind FROM seen JOIN fk ON (node = source OR node = target) WHERE depth < 3),
    sg AS (SELECT query_id, a AS path, 'DIRECT_DEPENDENT' AS kind, b AS other, 0.5::DOUBLE AS weight FROM w WHERE kind IN ('imports', 'references') UNION SELECT query_id, b, 'DIRECT_DEPENDENCY', a, 0.6::DOUBLE FROM w WHERE kind IN ('imports', 'references') UNION SELECT query_id, a, 'CALL_EDGE', b, 0.5::DOUBLE FROM w WHERE kind = 'calls' UNION SELECT query_id, b, 'CALL_EDGE', a, 0.5::DOUBLE FROM w WHERE kind = 'calls')"""


def walked_signals(spark, sf_dir):
    # Edges told twice are walked twice and become one where the signals are made, so only walked edges are moved.
    _, walked = graph.traverse(fk_edges(spark, sf_dir, repeated=True), starts(spark, "file:r0", "file:r2"), 3, both_ways=True, accept=graph.crosses_files(), unique=True, nodes=False)
    return graph.structural_signals(walked)


@query("j14_structural", SIGNALS + " SELECT * FROM sg")
def j14(spark, sf_dir):
    return walked_signals(spark, sf_dir)


@query("a11_structural_cap", SIGNALS + ", t AS (SELECT query_id, path, sum(weight) AS total FROM sg GROUP BY ALL) SELECT query_id, path, kind, other, round(weight * CASE WHEN total > 1 THEN 1 / total ELSE 1 END, 6) AS weight FROM sg JOIN t USING (query_id, path)")
def a11(spark, sf_dir):
    return graph.capped(walked_signals(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("a10_structural_max", SIGNALS + " SELECT query_id, path, max(weight) AS strongest, count(DISTINCT other)::BIGINT AS n_others FROM sg GROUP BY ALL")
def a10(spark, sf_dir):
    return walked_signals(spark, sf_dir).groupBy("query_id", "path").agg(F.max("weight").alias("strongest"), F.count_distinct("other").alias("n_others"))


@query("f03_cross_file", f"WITH {FK} SELECT source, target FROM fk WHERE source <> target AND kind <> 'calls'")
def f03(spark, sf_dir):
    return fk_edges(spark, sf_dir).filter("kind <> 'calls'").filter(graph.crosses_files()).select("source", "target")


@query("j17_neighbours", f"WITH {FK}, s AS (SELECT 'n' || n_nationkey AS seed FROM nation WHERE n_nationkey < 5) SELECT 0 AS query_id, substr(target, 6) AS path, seed FROM s JOIN fk ON source = 'file:' || seed UNION SELECT 0, substr(source, 6), seed FROM s JOIN fk ON target = 'file:' || seed")
def j17(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.lit(0).alias("query_id"), F.concat(F.lit("n"), "n_nationkey").alias("path"))
    return graph.neighbours(fk_edges(spark, sf_dir), seeds)


HUBS = f"{FK}, dg AS (SELECT x AS path, sum(n)::BIGINT AS degree FROM (SELECT substr(source, 6) AS x, count(DISTINCT target) AS n FROM fk GROUP BY ALL UNION ALL SELECT substr(target, 6), count(DISTINCT source) FROM fk GROUP BY ALL) GROUP BY x)"


def fk_files(e):
    nodes = e.select(F.col("source").alias("n")).unionByName(e.select(F.col("target").alias("n"))).distinct()
    return nodes.select(graph.file_of_node(F.col("n")).alias("path"), F.col("n").startswith("file:r").alias("is_test"))


@query("a16_hubs", f"WITH {HUBS} SELECT path, degree FROM dg WHERE path NOT LIKE 'r%' ORDER BY degree DESC, path LIMIT 12")
def a16(spark, sf_dir):
    e = written(fk_edges(spark, sf_dir), "fk")
    return graph.hubs(e, fk_files(e), 12)


@query("a16_part_supplier_degree", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_partkey ORDER BY suppliers DESC, l_partkey LIMIT 20")
def a16b(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers")).orderBy(F.desc("suppliers"), "l_partkey").limit(20)


@query("g07_project_ranking")
def g07(spark, sf_dir):
    e = written(fk_edges(spark, sf_dir), "fk")
    return project_ranking(written(fk_files(e), "files"), e)


@query("f09_entry_points", "WITH e(k, e) AS (VALUES (0, 'index.ts'), (1, 'main.py'), (2, 'Server.MJS'), (3, 'app.js'), (4, 'node_modules/index.js')), u AS (SELECT p_partkey, replace(p_name, ' ', '/') || '/' || e AS path FROM part JOIN e ON p_partkey % 5 = k) SELECT p_partkey, path FROM u WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^(index|main|app|server|entry)\\.[cm]?[jt]sx?$') AND NOT contains(path, 'node_modules')")
def f09(spark, sf_dir):
    names = ["index.ts", "main.py", "Server.MJS", "app.js", "node_modules/index.js"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "/"), F.lit("/"), name).alias("path")).filter(is_entry_point(F.col("path")))


@query("a18_folder_counts", f"WITH {DOCS}, p AS (SELECT string_split(path, '/') AS p FROM docs), f AS (SELECT unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS path FROM p) SELECT path, count(*)::BIGINT AS file_count FROM f GROUP BY path")
def a18(spark, sf_dir):
    return tree.folder_counts(doc_texts(spark, sf_dir))


NODES = f"""{DOCS}, p AS (SELECT path, string_split(path, '/') AS p FROM docs), f AS (SELECT p[1:i] AS q, count(*)::BIGINT AS n FROM (SELECT p, unnest(range(1, len(p))) AS i FROM p) GROUP BY ALL),
    nd AS (SELECT array_to_string(q, '/') AS path, len(q)::INTEGER AS depth, q[-1] AS name, true AS is_dir, n AS file_count FROM f UNION ALL SELECT path, len(p)::INTEGER, p[-1], false, 1 FROM p)"""


@query("a18_tree_nodes", f"WITH {NODES} SELECT path, name, depth, is_dir, file_count, regexp_replace(path, '/?[^/]*$', '') AS parent FROM nd WHERE depth <= 2")
def a18b(spark, sf_dir):
    return tree.tree_nodes(doc_texts(spark, sf_dir), 2).select("path", "name", "depth", "is_dir", "file_count", "parent")


@query("a18_tree_lines")
def a18c(spark, sf_dir):
    return tree.tree_lines(doc_texts(spark, sf_dir))


@query("a17_top_folders", f"WITH {DOCS} SELECT regexp_replace(path, '/?[^/]*$', '') AS path, count(*)::BIGINT AS file_count FROM docs GROUP BY ALL ORDER BY file_count DESC, path LIMIT 12")
def a17(spark, sf_dir):
    return tree.top_folders(doc_texts(spark, sf_dir))


EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.mjs", "/index.json"]


def _links(spark, sf_dir):
    """importer, specifier: the links of the pages, every third one made relative."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.select(F.concat(F.lit("site/p"), "page_id", F.lit(".html")).alias("importer"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./sub/.."), "href")).when(F.col("page_id") % 3 == 1, F.col("href")).otherwise(F.concat(F.lit("@scope"), "href", F.lit("/x"))).alias("specifier"))


LINKS = "links AS (SELECT DISTINCT 'site/p' || page_id || '.html' AS importer, CASE page_id % 3 WHEN 0 THEN './sub/..' || href WHEN 1 THEN href ELSE '@scope' || href || '/x' END AS specifier, page_id % 3 AS m, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages))"
FILES = "files AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'site' ELSE '' END || '/' || h || CASE length(h) % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.json' WHEN 2 THEN '/index.js' ELSE '' END AS path FROM (SELECT page_id, ltrim(href, '/') AS h FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)) WHERE h <> '')"


def _files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).select("page_id", F.expr("ltrim('/', href)").alias("h")).filter("h <> ''")
    tail = F.when(F.length("h") % 4 == 0, ".ts").when(F.length("h") % 4 == 1, ".json").when(F.length("h") % 4 == 2, "/index.js").otherwise("")
    return p.select(F.expr("ltrim('/', concat(CASE WHEN page_id % 2 = 0 THEN 'site' ELSE '' END, '/', h))").alias("base"), tail.alias("t")).select(F.concat("base", "t").alias("path")).distinct()


RESOLVED = f"""WITH {LINKS}, {FILES}, fs AS (SELECT DISTINCT ltrim(path, '/') AS path FROM files), j AS (SELECT importer, specifier, m, array_to_string(list_filter(string_split(CASE m WHEN 0 THEN 'site' || href ELSE ltrim(href, '/') END, '/'), lambda x: x NOT IN ('', '.')), '/') AS base FROM links),
    t AS (SELECT importer, specifier, m, base, unnest(list_transform(['', {', '.join("'" + e + "'" for e in EXTENSIONS + INDEXES)}], lambda e: base || e)) AS path, unnest(range(0, {1 + len(EXTENSIONS) + len(INDEXES)})) AS ord FROM j WHERE m < 2),
    h AS (SELECT importer, specifier, min_by(path, ord) AS path FROM t JOIN fs USING (path) GROUP BY ALL)"""


@query("j01_resolve_links", f"{RESOLVED} SELECT importer, specifier, CASE WHEN h.path IS NOT NULL THEN 'RESOLVED' WHEN m < 2 THEN 'UNRESOLVED' ELSE 'EXTERNAL' END AS status, h.path AS path FROM j LEFT JOIN h USING (importer, specifier)")
def j01(spark, sf_dir):
    links = _links(spark, sf_dir).filter("specifier not like '%..' or true")
    return resolve_imports(links, _files(spark, sf_dir)).select("importer", "specifier", "status", "path")


@query("j03_external_packages", f"WITH {LINKS} SELECT DISTINCT specifier, string_split(specifier, '/')[1] || '/' || string_split(specifier, '/')[2] AS package FROM links WHERE m = 2")
def j03(spark, sf_dir):
    return _links(spark, sf_dir).filter("specifier like '@%'").select("specifier", package_of(F.col("specifier")).alias("package")).distinct()


ALIASED = Inline("uses", "importer string, specifier string", [("a.ts", "@/lib/x"), ("a.ts", "@/none"), ("a.ts", "~"), ("a.ts", "#k/z"), ("b/c.ts", "react"), ("b/c.ts", "@s/p/q"), ("b/c.ts", ""), ("b/c.ts", "<dynamic>"), ("b/c.ts", "./d.js")])
KNOWN = Inline("known", "path string", [("src/lib/x.ts",), ("src/index.ts",), ("keys/z/index.mjs",), ("b/d.tsx",)])
ALIASES = [("@/", ["src"]), ("~/", ["src"]), ("#k/", ["none", "keys"])]


@query("j02_aliases", "SELECT * FROM (VALUES ('a.ts', '@/lib/x', 'RESOLVED', 'src/lib/x.ts', 'alias'), ('a.ts', '@/none', 'UNRESOLVED', NULL, 'alias @/ did not match any indexed file'), ('a.ts', '~', 'RESOLVED', 'src/index.ts', 'alias'), ('a.ts', '#k/z', 'RESOLVED', 'keys/z/index.mjs', 'alias'), ('b/c.ts', 'react', 'EXTERNAL', NULL, 'react'), ('b/c.ts', '@s/p/q', 'EXTERNAL', NULL, '@s/p'), ('b/c.ts', '', 'UNRESOLVED', NULL, 'dynamic or empty specifier'), ('b/c.ts', '<dynamic>', 'UNRESOLVED', NULL, 'dynamic or empty specifier'), ('b/c.ts', './d.js', 'RESOLVED', 'b/d.tsx', NULL)) t(importer, specifier, status, path, detail)")
def j02(spark, sf_dir):
    return resolve_imports(ALIASED.df(spark), KNOWN.df(spark), ALIASES)


@query("u04_distinct_edges", "SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'references' AS kind FROM lineitem")
def u04(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("references").alias("kind"), F.lit("PARSED").alias("provenance"), F.lit("").alias("detail"))
    return graph.unique_edges(d).select("source", "target", "kind")


@query("j21_dangling_targets", "SELECT 'p' || l_partkey AS target, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY ALL")
def j21(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("target"), "l_suppkey").distinct()
    known = table(spark, sf_dir, "part").filter("p_size < 40").select(F.concat(F.lit("p"), "p_partkey").alias("target"))
    return e.join(known, "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@query("j20_affected", f"WITH {FK}, ch AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_partkey % 11 = 0) SELECT DISTINCT substr(source, 6) AS path FROM fk WHERE substr(target, 6) IN (SELECT path FROM ch) UNION SELECT path FROM ch UNION SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def j20(spark, sf_dir):
    changed = table(spark, sf_dir, "part").filter("p_partkey % 11 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.lit("BUILDING").alias("name"))
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_mktsegment").alias("name"))
    none = spark.createDataFrame([], "path string, target string")
    return graph.affected(fk_edges(spark, sf_dir), none, names, changed)
