"""Queries of the scans and scalar functions over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import paths as P
from lodestone.functions import text as X
from lodestone.operators.lexical import body_terms, document_path
from lodestone.plans.base import DOCS, PATH, doc_texts, eval_words, listed, query, table, words
from lodestone.sources import scan, store

STOP = listed(config.STOPWORDS)
BODY = f"list_filter({words('text')}, lambda w: length(w) >= 2 AND w NOT IN {STOP})"
LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END::INTEGER"
EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]*)$', 1))"
LANGUAGE = "CASE " + " ".join(f"WHEN {EXT} IN {listed(e)} THEN '{n}'" for n, e in config.EXTENSIONS.items()) + " ELSE 'generic' END"
def binary(content: str) -> str:
    """The first bytes of a blob, by their hexadecimal digits."""
    return f"(regexp_matches(left(hex({content}), 16384), '^(..)*?00') OR 10 * len(list_filter(regexp_extract_all(left(hex({content}), 2048), '..'), lambda x: x < '09' OR (x >= '0E' AND x < '20'))) > least(1024, octet_length({content})))"


BINARY = binary("encode(text)")
TEST = r"(regexp_matches(regexp_extract(lower(path), '[^/]*$'), '\.(test|spec)\.[a-z]+$|\.(test|spec)\.[jt]sx?$') OR contains(lower(path), '/__tests__/') OR contains(lower(path), '.test.') OR starts_with(regexp_extract(lower(path), '[^/]*$'), 'test-'))"
MAX = scan.MAX_BYTES


def doc_files(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    return d.select("path", F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))


@query(
    "s01_scan",
    f"""WITH {DOCS}, d AS (SELECT *, octet_length(encode(text))::BIGINT AS size_bytes FROM docs),
    e AS (SELECT *, CASE WHEN size_bytes > {MAX} THEN 'SKIPPED_TOO_LARGE' WHEN {BINARY} THEN 'SKIPPED_BINARY' ELSE 'OK' END AS status FROM d)
    SELECT path, {LANGUAGE} AS language, size_bytes, CASE WHEN status = 'OK' THEN {LINES} END AS line_count, CASE WHEN status = 'OK' THEN sha256(text) END AS content_hash, {TEST} AS is_test, status FROM e""",
)
def s01(spark, sf_dir):
    return scan.scan(doc_files(spark, sf_dir), MAX).drop("text")


@query("s02_size_cap", f"WITH {DOCS} SELECT path, octet_length(encode(text))::BIGINT AS length FROM docs WHERE octet_length(encode(text)) <= " + str(MAX))
def s02(spark, sf_dir):
    return doc_files(spark, sf_dir).filter(F.col("length") <= MAX).select("path", "length")


ODD = f"d AS (SELECT path, CASE n % 4 WHEN 0 THEN unhex('FFFE41') WHEN 1 THEN unhex('00') WHEN 2 THEN unhex('E282') ELSE ''::BLOB END || encode(text) AS content FROM (SELECT {PATH} AS path, coalesce(text, '') AS text, coalesce(doc_id, 3) AS n FROM documents))"


@query(
    "s09_broken_bytes",
    f"""WITH {ODD}, e AS (SELECT *, octet_length(content)::BIGINT AS size_bytes, CASE WHEN octet_length(content) > {MAX} THEN 'SKIPPED_TOO_LARGE' WHEN {binary("content")} THEN 'SKIPPED_BINARY' ELSE 'OK' END AS status FROM d)
    SELECT path, size_bytes, status, CASE WHEN status = 'OK' THEN sha256(content) END AS content_hash FROM e""",
)
def s09_bytes(spark, sf_dir):
    """Documents behind bytes that are no text or no UTF-8."""
    k = F.coalesce("doc_id", F.lit(3)) % 4
    lead = F.when(k == 0, F.unhex(F.lit("FFFE41"))).when(k == 1, F.unhex(F.lit("00"))).when(k == 2, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(lead, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    d = table(spark, sf_dir, "documents").select(document_path().alias("path"), content.alias("content"))
    return scan.scan(d.withColumn("length", F.octet_length("content").cast("long"))).select("path", "size_bytes", "status", "content_hash")


@query("s03_traversal", r"SELECT page_id, list_contains(regexp_split_to_array(url, '[/\\]'), '..') AS climbs FROM pages")
def s03(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.has_traversal(F.col("url")).alias("climbs"))


PATTERNS = scan.parse_patterns(["*.tmp", "src1/", "!src1/en/", "/src2/de", "*7.md", "!*17.md"]) + scan.builtin_patterns() + scan.parse_patterns(["3*.md", "!33.md"], "src0/en", first=50)
_P = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in p) + ")" for p in PATTERNS)


@query(
    "s05_ignore_rules",
    f"""WITH {DOCS}, patterns(ordinal, raw, source_dir, regex, negated, dir_only, builtin) AS (VALUES {_P}),
    parts AS (SELECT path, string_split(path, '/') AS p FROM docs), nodes AS (SELECT path, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS node FROM parts),
    met AS (SELECT path, node, node <> path AS is_dir, q.*, CASE WHEN source_dir = '' THEN node ELSE substr(node, length(source_dir) + 2) END AS below FROM nodes JOIN patterns q ON source_dir = '' OR starts_with(node, source_dir || '/')),
    up AS (SELECT *, string_split(below, '/') AS b FROM met),
    hit AS (SELECT * FROM up WHERE CASE WHEN dir_only AND NOT is_dir THEN len(list_filter(range(1, len(b)), lambda i: regexp_matches(array_to_string(b[1:i], '/'), regex))) > 0 ELSE regexp_matches(below, regex) END),
    per AS (SELECT path, node, bool_or(builtin) AS fixed, max_by(negated, ordinal) FILTER (NOT builtin) AS neg FROM hit GROUP BY ALL)
    SELECT d.path, coalesce(bool_or(fixed OR NOT coalesce(neg, true)), false) AS excluded FROM docs d LEFT JOIN per USING (path) GROUP BY d.path""",
)
def s05(spark, sf_dir):
    return scan.excluded(doc_texts(spark, sf_dir).select("path"), scan.ignore_patterns(spark, PATTERNS))


GLOBS = ["*.md", "**/de/*", "src?/en/**", "src[0-3]/**/1*.md", "a/b"]


@query("s06_globs", "WITH " + DOCS + " SELECT path, " + ", ".join(f"regexp_matches(path, '{P.glob_regex(g, '/' in g)}') AS g{k}" for k, g in enumerate(GLOBS)) + " FROM docs")
def s06(spark, sf_dir):
    return doc_texts(spark, sf_dir).select("path", *[F.col("path").rlike(P.glob_regex(g, "/" in g)).alias(f"g{k}") for k, g in enumerate(GLOBS)])


@query("s09_binary", f"WITH {DOCS} SELECT path, {BINARY} AS looks_binary FROM docs")
def s09(spark, sf_dir):
    return doc_texts(spark, sf_dir).select("path", scan.looks_binary(F.encode("text", "UTF-8")).alias("looks_binary"))


@query("s10_language", f"WITH u AS (SELECT page_id, url AS path FROM pages) SELECT page_id, {EXT} AS ext, {LANGUAGE} AS language FROM u")
def s10(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", P.ext_name(u).alias("ext"), P.detect_language(u).alias("language"))


@query("s11_test_files", f"WITH u AS (SELECT p_partkey, replace(p_name, ' ', '.') || CASE WHEN p_size % 3 = 0 THEN '.test.ts' WHEN p_size % 3 = 1 THEN '_test.go' ELSE '.ts' END AS path FROM part) SELECT p_partkey, {TEST} AS is_test, CASE WHEN regexp_matches(path, '\\.test\\.[^.]+$') THEN regexp_replace(path, '\\.test(\\.[^.]+)$', '\\1') WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN regexp_replace(path, '_test\\.go$', '.go') END AS tested FROM u")
def s11(spark, sf_dir):
    size = F.col("p_size") % 3
    path = F.concat(F.regexp_replace("p_name", " ", "."), F.when(size == 0, ".test.ts").when(size == 1, "_test.go").otherwise(".ts"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select("p_partkey", P.is_test_file(F.col("path")).alias("is_test"), P.source_of_test(F.col("path")).alias("tested"))


@query("s12_count_lines", f"WITH {DOCS} SELECT path, {LINES} AS n_lines FROM docs")
def s12(spark, sf_dir):
    return doc_texts(spark, sf_dir).select("path", scan.count_lines(F.col("text")).alias("n_lines"))


@query("s13_hash", f"WITH {DOCS} SELECT path, sha256(text) AS hash, left(sha256(text), 8) AS short_hash FROM docs")
def s13(spark, sf_dir):
    h = F.sha2("text", 256)
    return doc_texts(spark, sf_dir).select("path", h.alias("hash"), F.substring(h, 1, 8).alias("short_hash"))


@query("s16_manifest", f"""WITH {DOCS}, a AS (SELECT path, sha256(text) AS h FROM docs), o AS (SELECT * FROM a WHERE h < 'f'), n AS (SELECT path, CASE WHEN h < '2' THEN left(h, 8) ELSE h END AS h FROM a WHERE h >= '1')
    SELECT coalesce(o.path, n.path) AS path, o.h AS ours, n.h AS derived FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h""")
def s16(spark, sf_dir):
    a = doc_texts(spark, sf_dir).select("path", F.sha2("text", 256).alias("content_hash"))
    new = a.filter("content_hash >= '1'").withColumn("content_hash", F.when(F.col("content_hash") < "2", F.substring("content_hash", 1, 8)).otherwise(F.col("content_hash")))
    return store.manifest_differs(a.filter("content_hash < 'f'"), new)


@query("s17_index_version", f"""WITH {DOCS}, l AS (SELECT path || ':' || sha256(text) AS line, sha256(path) AS p FROM docs),
    b AS (SELECT substr(p, 1, 2) AS s, substr(p, 3, 2) AS s2, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY ALL), c AS (SELECT s, sha256(string_agg(h, chr(10) ORDER BY s2)) AS h FROM b GROUP BY s)
    SELECT left(sha256(string_agg(h, chr(10) ORDER BY s)), 12) AS index_version FROM c""")
def s17(spark, sf_dir):
    return store.index_version(doc_texts(spark, sf_dir).select("path", F.sha2("text", 256).alias("content_hash")))


@query("s32_synthetic", "SELECT count(*)::BIGINT AS files, sum(length(text))::BIGINT AS chars, sum(CASE WHEN text LIKE 'import%' THEN 1 ELSE 0 END)::BIGINT AS importing FROM (SELECT CASE WHEN id % 10 > 0 THEN 'import { fn' || (id % 10 - 1) || ' } from ''./file' || (id % 10 - 1) || ''';' || chr(10) ELSE '' END || 'export function fn' || (id % 10) || '(x: number): number {' || chr(10) || '  return x + ' || (id // 10) || ';' || chr(10) || '}' || chr(10) AS text FROM range(500) r(id))")
def s32(spark, sf_dir):
    return scan.synthetic_tree(spark, 50).agg(F.count("*").alias("files"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.col("text").startswith("import")).alias("importing"))


@query("t01_tokens", f"WITH {DOCS}, t AS (SELECT path, {words('text')} AS w FROM docs) SELECT path, len(w)::INTEGER AS n, sha256(array_to_string(w, ' ')) AS digest FROM t")
def t01(spark, sf_dir):
    t = X.tokenize_identifier(F.col("text"))
    return doc_texts(spark, sf_dir).select("path", F.size(t).alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("t02_canonical", f"SELECT p_partkey, array_to_string({words('p_name')}, '') AS canonical, len({words('p_name')})::INTEGER AS n_tokens FROM part")
def t02(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.canonical_term(F.col("p_name")).alias("canonical"), F.size(X.tokenize_identifier(F.col("p_name"))).alias("n_tokens"))


@query("t03_variants", f"WITH t AS (SELECT p_partkey, {words('p_brand')} AS w FROM part) SELECT p_partkey, array_to_string(w, '') || '|' || array_to_string(w, '_') || '|' || array_to_string(w, '-') AS variants FROM t WHERE len(w) > 1")
def t03(spark, sf_dir):
    d = table(spark, sf_dir, "part").filter(F.size(X.tokenize_identifier(F.col("p_brand"))) > 1)
    return d.select("p_partkey", F.array_join(X.identifier_variants(F.col("p_brand")), "|").alias("variants"))


@query("t04_stopwords", f"WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w) NOT IN {STOP}) AS w FROM conversations) SELECT conv_id, turn, len(w)::INTEGER AS n, array_to_string(w, ' ') AS kept FROM t")
def t04(spark, sf_dir):
    w = X.strip_stopwords(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(w).alias("n"), F.array_join(w, " ").alias("kept"))


@query("t05_string_order", "SELECT page_id, url, row_number() OVER (ORDER BY url, page_id)::BIGINT AS place FROM pages")
def t05(spark, sf_dir):
    from lodestone.operators import ranks

    return ranks.ordered_rank(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], "place")


@query("t06_posix_paths", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), s AS (SELECT page_id, href, string_split(regexp_replace(regexp_replace(replace('docs/x/' || href, '\', '/'), '^[A-Za-z]:', ''), '^/+', ''), '/') AS p FROM h),
    f AS (SELECT page_id, href, list_reduce(list_prepend([]::VARCHAR[], list_transform(p, lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END) AS q FROM s)
    SELECT page_id, href, array_to_string(q, '/') AS path, coalesce(q[-1], '') AS base FROM f""")
def t06(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.withColumn("path", P.to_posix(F.concat(F.lit("docs/x/"), "href"))).withColumn("base", P.base_name(F.col("path")))


@query("t07_node_ids", f"SELECT {PATH} || '#' || lang || '@heading:' || n_chars AS id, {PATH} AS file FROM documents WHERE lang IS NOT NULL")
def t07(spark, sf_dir):
    from lodestone.operators.graph import file_of_node, symbol_id, symbol_node

    d = table(spark, sf_dir, "documents").filter("lang is not null")
    i = symbol_id(document_path(), F.col("lang"), F.lit("heading"), F.col("n_chars"))
    return d.select(i.alias("id"), file_of_node(symbol_node(i)).alias("file"))


@query("t08_body_terms", f"""WITH {DOCS}, t AS (SELECT path, unnest({BODY}) AS term FROM docs), c AS (SELECT path, term, count(*) AS n FROM t GROUP BY ALL),
    r AS (SELECT path, term, least(n, 8) AS tf, sum(n) OVER (PARTITION BY path)::BIGINT AS body_length FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tf DESC, term) AS k FROM r)
    SELECT path, term, tf::BIGINT AS tf, body_length FROM k WHERE k <= 192""")
def t08(spark, sf_dir):
    return body_terms(doc_texts(spark, sf_dir)).withColumn("tf", F.col("tf").cast("long"))


@query("t09_identifiers", f"WITH {DOCS}, i AS (SELECT path, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{{2,}}') AS a FROM docs), d AS (SELECT path, list_filter(a, lambda x, k: list_position(a, x) = k)[1:400] AS u FROM i) SELECT path, len(u)::INTEGER AS n, sha256(array_to_string(u, ' ')) AS digest FROM d")
def t09(spark, sf_dir):
    i = X.extract_identifiers(F.col("text"))
    return doc_texts(spark, sf_dir).select("path", F.size(i).alias("n"), F.sha2(F.array_join(i, " "), 256).alias("digest"))


def _analysis(source: str, key: str) -> str:
    q = "\"([^\"]+)\"|''([^'']+)''"
    return rf"""WITH a AS (SELECT {key}, text, list_filter(list_transform(regexp_extract_all(text, '{q}'), lambda x: trim(x[2:-2])), lambda x: x <> '') AS phrases,
      list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '{q}', ' ', 'g'), '[\s,;:!?()\[\]{{}}]+'), lambda w: regexp_replace(w, '^[^\w$@/]+|[^\w$./]+$', '', 'g')), lambda w: w <> '' AND lower(w) NOT IN {STOP}) AS words FROM {source}),
    b AS (SELECT *, list_filter(list_transform(list_filter(words, lambda w: NOT regexp_matches(w, '\.[A-Za-z0-9]+$')), lambda w: regexp_replace(w, '^[^A-Za-z0-9_$]+|[^A-Za-z0-9_$]+$', '', 'g')), lambda w: regexp_matches(w, '^[a-zA-Z_$][a-zA-Z0-9_$]*$')) AS cands,
      list_concat(flatten(list_transform(words, lambda y: {words('y')})), flatten(list_transform(phrases, lambda y: {words('y')}))) AS tok FROM a),
    c AS (SELECT *, list_filter(tok, lambda x, k: list_position(tok, x) = k) AS terms, list_filter(list_transform(cands, lambda y: array_to_string({words('y')}, '')), lambda y: y <> '') AS canon FROM b)
    SELECT {key}, array_to_string(phrases, '|') AS phrases, array_to_string(words, '|') AS words, array_to_string(list_transform(list_filter(words, lambda w: regexp_matches(w, '\.[A-Za-z0-9]+$')), lambda w: lower(w)), '|') AS hints,
      array_to_string(terms, '|') AS terms, array_to_string(list_filter(canon, lambda x, k: list_position(canon, x) = k), '|') AS exact FROM c"""


@query("t10_analyze_query", _analysis("(SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)", "conv_id, turn"))
def t10(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null")
    a = X.analyze_query(F.col("text"))
    named = {"phrases": "quoted_phrases", "words": "words", "hints": "file_hints", "terms": "terms", "exact": "exact_candidates"}
    return d.select("conv_id", "turn", *[F.array_join(a[v], "|").alias(k) for k, v in named.items()])


ESTOP = listed(config.EVAL_STOPWORDS)


@query("t11_eval_tokens", f"WITH {DOCS}, t AS (SELECT path, {eval_words('text')} AS w, {eval_words(chr(39).join(['regexp_replace(text, ', chr(92) + 'bv' + chr(92) + 'd+' + chr(92) + 'b', ', ', ' ', ', ', 'gi', ')']))} AS v FROM docs) SELECT path, len(w)::INTEGER AS n_tokens, len(list_filter(w, lambda x: x NOT IN {ESTOP}))::INTEGER AS n_content, len(list_filter(v, lambda x: x NOT IN {ESTOP}))::INTEGER AS n_words FROM t")
def t11(spark, sf_dir):
    t = F.col("text")
    return doc_texts(spark, sf_dir).select("path", F.size(X.tokenize(t)).alias("n_tokens"), F.size(X.content_words(t)).alias("n_content"), X.word_count(t).alias("n_words"))


@query("t12_path_tokens", r"SELECT page_id, array_to_string(" + eval_words(r"regexp_replace(regexp_replace(replace(url, '\', '/'), '(?i)\.[a-z0-9]+$', ''), '(^|/)(packages?|libs?|modules?|ts|js|src|lib)($|/|$)', ' ', 'g')") + ", ' ') AS tokens FROM pages")
def t12(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(P.path_tokens(F.col("url")), " ").alias("tokens"))


@query("t13_clean_task", r"""WITH c AS (SELECT doc_id, 'Fix crash (#' || doc_id || ') in ' || lang AS subject, coalesce(text, '') AS body FROM documents WHERE lang IS NOT NULL), l AS (SELECT doc_id, subject, list_filter(list_transform(regexp_split_to_array(body, '\r?\n'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '(?i)^(co-authored-by|signed-off-by|reviewed-by|acked-by|reported-by|tested-by)\s*:')) AS k FROM c),
    a AS (SELECT doc_id, subject, trim(subject || ' ' || array_to_string(k, ' ')) AS x FROM l), b AS (SELECT doc_id, subject, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\(cherry picked from commit [0-9a-f]+\)', '', 'g'), 'https?://\S+', ' ', 'g'), '(?i)[a-z0-9.\-+/]+@[a-z0-9.\-]+', ' ', 'g'), '\(#\d+\)', ' ', 'g') AS x FROM a)
    SELECT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS task FROM b""")
def t13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    subject = F.concat(F.lit("Fix crash (#"), F.col("doc_id"), F.lit(") in "), "lang")
    return d.select("doc_id", X.clean_task_text(subject, F.coalesce("text", F.lit(""))).alias("task"))


@query("t15_token_estimates", f"WITH {DOCS} SELECT path, ceil(length(text) / 4.0)::BIGINT AS tokens, greatest(10, floor(ceil(length(text) / 4.0) / 10.0 + 0.5) * 10)::BIGINT AS approx FROM docs")
def t15(spark, sf_dir):
    n = X.estimate_tokens(F.length("text"))
    return doc_texts(spark, sf_dir).select("path", n.alias("tokens"), X.estimate_tokens_approx(n).alias("approx"))


@query("t16_code_block", f"""WITH {DOCS}, l AS (SELECT path, text, string_split(text, chr(10)) AS a FROM docs), m AS (SELECT path, text, CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END AS a FROM l)
    SELECT path, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::INTEGER AS fence, sha256(array_to_string(list_transform(a, lambda x, i: i || ': ' || x), chr(10))) AS digest FROM m""")
def t16(spark, sf_dir):
    lines = X.split_lines(F.col("text"))
    return doc_texts(spark, sf_dir).select("path", X.fence_length(F.col("text")).cast("int").alias("fence"), F.sha2(X.number_lines(lines), 256).alias("digest"))


@query("t17_fnv1a", "SELECT p_partkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::UBIGINT)), lambda a, c: ((xor(a, c)::UHUGEINT * 16777619) % 4294967296)::UBIGINT)::BIGINT AS hash FROM part")
def t17(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("hash"))


@query("t18_placeholder", f"SELECT c_custkey, '[REDACTED:jwt:' || left(sha256(c_name), 8) || ']' AS placeholder FROM customer")
def t18(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.redaction_placeholder(F.lit("jwt"), F.col("c_name")).alias("placeholder"))


CLASSES = {"lockfile": P.is_lockfile, "docs": P.is_docs, "ci": P.is_ci_config, "test": P.is_test_path, "source": P.is_source, "parsed": P.is_fully_parsed, "generated": P.is_generated_or_lockfile}
ENDS = [".md", ".ts", ".test.ts", "/package-lock.json", ".d.ts", ".yml", ".min.js", ".json", "/docs/a.txt", "/dist/b.js", "/tests/c.js", "/readme"]


@query("t20_path_classes", "WITH e(k, e) AS (VALUES " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(ENDS)) + f"), u AS (SELECT p_partkey, replace(p_name, ' ', '/') || e AS path FROM part JOIN e ON p_partkey % {len(ENDS)} = k), l AS (SELECT *, regexp_extract(lower(path), '[^/]*$') AS base FROM u) SELECT p_partkey, path, base IN {listed(config.LOCKFILES)} AS lockfile, regexp_matches(path, '{config.DOCS_PATH}') AS docs, regexp_matches(path, '{config.CI_PATH}') AS ci, regexp_matches(path, '{config.TEST_PATH}') AS test, regexp_matches(path, '{config.SOURCE_PATH}') AND NOT regexp_matches(path, '{config.TEST_PATH}') AND NOT regexp_matches(path, '{config.DECLARATION_PATH}') AS source, regexp_matches(path, '{config.PARSED_PATH}') AS parsed, regexp_matches(lower(path), '{config.GENERATED_PATH}') OR base IN {listed(config.SEED_LOCKFILES)} AS generated FROM l")
def t20(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (F.col("p_partkey") % len(ENDS) + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "/"), ends).alias("path"))
    return d.select("p_partkey", "path", *[f(F.col("path")).alias(n) for n, f in CLASSES.items()])


@query("t22_exact_weights", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 WHEN 4 THEN 0.4 ELSE 0.6 END::DOUBLE AS weight FROM part")
def t22(spark, sf_dir):
    kinds = ["function", "method", "class", "enum", "interface", "variable"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.exact_weight_for_kind(kind).alias("weight"))


@query("t24_sensitive_paths", "WITH e(k, e) AS (VALUES (0, '.env'), (1, '.env.local'), (2, 'a.PEM'), (3, 'id_rsa'), (4, 'secrets.yml'), (5, '.npmrc'), (6, 'x.md'), (7, '.git-credentials')), u AS (SELECT page_id, regexp_replace(url, '[^/]*$', '') || e AS path FROM pages JOIN e ON page_id % 8 = k) SELECT page_id, path, " + "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN '{r}' END" for p, r in config.SENSITIVE_PATHS) + ") AS reason FROM u")
def t24(spark, sf_dir):
    names = [".env", ".env.local", "a.PEM", "id_rsa", "secrets.yml", ".npmrc", "x.md", ".git-credentials"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[^/]*$", ""), name).alias("path"))
    return d.withColumn("reason", P.sensitive_reason(F.col("path")))


@query("t25_entropy", "WITH c AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch FROM customer), f AS (SELECT c_custkey, ch, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT c_custkey, n / sum(n) OVER (PARTITION BY c_custkey) AS p FROM f) SELECT c_custkey, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY c_custkey")
def t25(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(X.shannon_entropy(F.col("c_name")), 6).alias("entropy"))
