"""Queries of the lexical index, the baselines and retrieval, over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.config import LEXICAL, RETRIEVAL, Lexical, Retrieval
from lodestone.functions import text as X
from lodestone.operators import baselines, lexical
from lodestone.plans.base import DOCS, TASKS, benchmark_tasks, doc_texts, eval_words, query, table, words
from lodestone.plans.retrieve import Corpus, content_signals, explained, retrieve, same_directory, seeds_of
from lodestone.plans.text_queries import BODY, STOP
from lodestone.sources.shared import spread

IDS = "list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}'), lambda w: true)"


def postings_sql(body: bool = True) -> str:
    lx = LEXICAL
    body_part = f"+ CASE WHEN body > 0 AND k <= {lx.body_terms} THEN {lx.body_weight}::DOUBLE * (tf * {lx.k1 + 1}::DOUBLE) / (tf + {lx.k1}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * least(len, {2 * lx.reference_length}) / {lx.reference_length}::DOUBLE)) ELSE 0 END" if body else ""
    damp = lambda c, w: f"CASE WHEN {c} > 0 THEN {w}::DOUBLE * (1 + ln(least({c}, {lx.max_tf}))) ELSE 0 END"
    return rf"""{DOCS}, ids AS (SELECT path, list_filter({IDS}, lambda x: true) AS a FROM docs), ids2 AS (SELECT path, list_filter(a, lambda x, k: list_position(a, x) = k)[1:{lx.identifiers}] AS u FROM ids),
    items AS (SELECT path, 'path' AS kind, unnest({words("regexp_replace(path, '[/_.]', ' ', 'g')")}) AS term FROM docs
      UNION ALL SELECT path, 'whole', array_to_string({words("regexp_replace(path, '[/_.]', ' ', 'g')")}, '') FROM docs WHERE len({words("regexp_replace(path, '[/_.]', ' ', 'g')")}) > 1
      UNION ALL SELECT path, 'identifier', unnest(flatten(list_transform(u, lambda i: {words('i')}))) FROM ids2 UNION ALL SELECT path, 'body', unnest({BODY}) FROM docs),
    counts AS (SELECT path, term, count(*) FILTER (kind = 'path') AS np, count(*) FILTER (kind = 'whole') AS nw, count(*) FILTER (kind = 'identifier') AS ni, count(*) FILTER (kind = 'body') AS body FROM items GROUP BY ALL),
    ranked AS (SELECT *, least(body, {lx.body_max_tf}) AS tf, sum(body) OVER (PARTITION BY path) AS len, row_number() OVER (PARTITION BY path ORDER BY least(body, {lx.body_max_tf}) DESC, term) AS k FROM counts),
    postings AS (SELECT term, path, {damp('np', lx.path)} + {damp('nw', lx.path)} + {damp('ni', lx.identifier)} {body_part} AS wtf FROM ranked),
    post AS (SELECT * FROM postings WHERE wtf > 0)"""


VOCAB = f"""{postings_sql()}, nd AS (SELECT count(*) AS n FROM docs), vocab AS (SELECT term, count(*) AS df, ln(1 + any_value(n) / count(*)) AS idf, ln(1 + greatest(1, any_value(n))) AS max_idf FROM post, nd GROUP BY term)"""
TOK = "list_transform(regexp_split_to_array(regexp_replace(text, '\"([^\"]+)\"|''([^'']+)''', ' ', 'g'), '[\\s,;:!?()\\[\\]{}]+'), lambda w: regexp_replace(w, '^[^\\w$@/]+|[^\\w$./]+$', '', 'g'))"
TERMS = f"""{TASKS}, qa AS (SELECT query_id, list_concat(flatten(list_transform(list_filter({TOK}, lambda w: w <> '' AND lower(w) NOT IN {STOP}), lambda y: {words('y')})), flatten(list_transform(regexp_extract_all(text, '"([^"]+)"|''([^'']+)'''), lambda y: {words('y')}))) AS tok FROM tasks),
    qb AS (SELECT query_id, list_filter(tok, lambda x, k: list_position(tok, x) = k) AS ts FROM qa), qt AS (SELECT query_id, unnest(ts) AS term, len(ts) AS n_terms FROM qb)"""
KEYS = f"""wanted AS (SELECT DISTINCT term FROM qt), keys0 AS (SELECT w.term, v.term AS key, v.idf AS key_idf, 1.0::DOUBLE AS factor FROM wanted w JOIN vocab v USING (term)
      UNION ALL SELECT w.term, v.term, v.idf, {LEXICAL.prefix_discount}::DOUBLE FROM wanted w JOIN vocab v ON left(w.term, 1) = left(v.term, 1) AND v.term <> w.term AND (starts_with(v.term, w.term) OR starts_with(w.term, v.term)) AND least(length(v.term), length(w.term)) >= least(4, length(w.term))),
    keys AS (SELECT *, coalesce(max(key_idf) FILTER (factor = 1.0) OVER (PARTITION BY term), max(key_idf) OVER (PARTITION BY term)) AS term_idf FROM keys0)"""
LEX = f"""WITH {VOCAB}, {TERMS}, {KEYS}, sums AS (SELECT query_id, sum(term_idf) AS idf_sum FROM qt JOIN (SELECT DISTINCT term, term_idf FROM keys) USING (term) GROUP BY query_id),
    hits AS (SELECT query_id, path, q.term, n_terms, p.wtf * key_idf / (idf_sum * {LEXICAL.max_weight}::DOUBLE) * factor AS part FROM qt q JOIN keys k ON q.term = k.term JOIN sums USING (query_id) JOIN post p ON p.term = k.key),
    lex AS (SELECT query_id, path, 0.9::DOUBLE * sum(part) * (0.6::DOUBLE + 0.4::DOUBLE * count(DISTINCT term) / max(n_terms)) AS weight, count(DISTINCT term)::INTEGER AS matched FROM hits GROUP BY ALL)"""


_CORPORA: dict[tuple, Corpus] = {}


def _state(spark, path: str) -> tuple:
    """The files below a path as they are now: name, length and time of change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))


def _there(spark, df) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def corpus(spark, sf_dir, identifiers: int | None = LEXICAL.identifiers) -> Corpus:
    """The corpus of the documents as they are: indexed once in a session, and anew when their files have changed or the
    index is gone. identifiers: how many of a document count; None for all."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{sf_dir}/documents.parquet"), identifiers)
    got = _CORPORA.get(key)
    if got is None or not all(_there(spark, c.index) for c in (got, *got.asked.values()) if c.index is not None):
        got = _CORPORA[key] = _corpus(spark, sf_dir, identifiers)
    return got


def _corpus(spark, sf_dir, identifiers: int | None) -> Corpus:
    return Corpus(lexical.document_entries(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), identifiers))


@query("a01_postings", f"WITH {postings_sql()} SELECT term, path, round(wtf, 6) AS wtf FROM post")
def a01(spark, sf_dir):
    return lexical.postings(corpus(spark, sf_dir).entries).select("term", "path", F.round("wtf", 6).alias("wtf"))


@query("a02_without_body", f"WITH {postings_sql(False)} SELECT term, count(*)::BIGINT AS n, round(sum(wtf), 4) AS total FROM post GROUP BY term")
def a02(spark, sf_dir):
    """The structured fields alone: whole names count as terms of their own, and the body is switched off."""
    d = lexical.postings(corpus(spark, sf_dir).entries, Lexical(body=False))
    return d.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("wtf"), 4).alias("total"))


@query("a03_body_weight", f"""WITH {DOCS}, t AS (SELECT path, unnest({BODY}) AS term FROM docs), c AS (SELECT path, term, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT path, term, least(n, 8) AS tf, sum(n) OVER (PARTITION BY path) AS len FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tf DESC, term) AS k FROM r) SELECT path, term, round(0.5::DOUBLE * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * least(len, 4000) / 2000::DOUBLE)), 6) AS weight FROM k WHERE k <= 192""")
def a03(spark, sf_dir):
    return lexical.body_terms(doc_texts(spark, sf_dir)).select("path", "term", F.round(lexical.body_weight(F.col("tf"), F.col("body_length")), 6).alias("weight"))


@query("a04_idf", f"WITH {VOCAB} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM vocab")
def a04(spark, sf_dir):
    return corpus(spark, sf_dir).prepared().vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query("a05_term_idf", f"WITH {VOCAB}, {TERMS}, {KEYS} SELECT DISTINCT term, round(term_idf, 6) AS term_idf FROM keys")
def a05(spark, sf_dir):
    keys = lexical.term_keys(lexical.query_terms(benchmark_tasks(spark, sf_dir)), corpus(spark, sf_dir).prepared().vocab)
    return keys.select("term", F.round("term_idf", 6).alias("term_idf")).distinct()


@query("a06_lexical_score", f"{LEX} SELECT query_id, path, round(weight, 6) AS weight, matched FROM lex")
def a06(spark, sf_dir):
    c = corpus(spark, sf_dir).prepared()
    return lexical.lexical_scores(c.index, c.vocab, benchmark_tasks(spark, sf_dir)).select("query_id", "path", F.round("weight", 6).alias("weight"), "matched")


@query("a07_specificity", f"WITH {VOCAB} SELECT term, round(least(1, idf / max_idf), 6) AS specificity FROM vocab")
def a07(spark, sf_dir):
    v = corpus(spark, sf_dir).prepared().vocab
    return v.select("term", F.round(lexical.specificity(F.col("idf"), F.col("max_idf")), 6).alias("specificity"))


@query("j09_query_postings", f"WITH {postings_sql()}, {TERMS} SELECT query_id, term, count(*)::BIGINT AS n_paths FROM qt JOIN post USING (term) GROUP BY ALL")
def j09(spark, sf_dir):
    terms = lexical.query_terms(benchmark_tasks(spark, sf_dir)).select("query_id", "term")
    return lexical.postings_of(terms, corpus(spark, sf_dir).prepared().index).groupBy("query_id", "term").agg(F.count("*").alias("n_paths"))


@query("j10_prefix_match", f"WITH {VOCAB}, {TERMS}, {KEYS} SELECT term, key FROM keys WHERE factor < 1")
def j10(spark, sf_dir):
    terms = lexical.query_terms(benchmark_tasks(spark, sf_dir))
    return lexical.prefix_matches(terms, corpus(spark, sf_dir).prepared().vocab).select("term", "key")


NAMES = "names AS (SELECT p_partkey, p_name || '.ts' AS path FROM part), cand AS (SELECT DISTINCT lower(p_type) AS t FROM part)"


@query("j12_file_names", rf"""WITH n AS (SELECT 'src/' || p_name || '.ts' AS path, array_to_string({words("p_name")}, '') AS base FROM part), q AS (SELECT c_custkey AS query_id, c_mktsegment AS text FROM customer),
    p AS (SELECT p_partkey + 1000000 AS query_id, split_part(p_name, ' ', 1) AS text FROM part), c AS (SELECT query_id, array_to_string({words("text")}, '') AS candidate FROM (SELECT * FROM q UNION ALL SELECT * FROM p) WHERE lower(text) NOT IN {STOP} AND regexp_matches(text, '^[a-zA-Z_$][a-zA-Z0-9_$]*$'))
    SELECT DISTINCT query_id, path, candidate, CASE WHEN base = candidate THEN 1.0 ELSE 0.5 END::DOUBLE AS share FROM n JOIN c ON base = candidate OR (length(candidate) >= 4 AND starts_with(base, candidate))""")
def j12(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_name", F.lit(".ts")).alias("path")).distinct()
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("text"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("query_id"), F.element_at(F.split("p_name", " "), 1).alias("text"))
    return lexical.file_name_matches(names, q.unionByName(p))


BM25 = rf"""WITH {DOCS}, {TASKS}, d AS (SELECT path, {eval_words('left(text, 500000)')}[1:50000] AS tok, list_distinct({eval_words("regexp_replace(regexp_replace(path, '(?i)\\.[a-z0-9]+$', ''), '(^|/)(packages?|libs?|modules?|ts|js|src|lib)($|/|$)', ' ', 'g')")}) AS own FROM docs),
    s AS (SELECT count(*) AS n, avg(len(tok)) AS al FROM d), a AS (SELECT DISTINCT query_id, unnest({eval_words('text')}) AS term FROM tasks), tf AS (SELECT path, len(tok) AS len, unnest(tok) AS term FROM d), c AS (SELECT path, any_value(len) AS len, term, count(*) AS tf FROM tf GROUP BY path, term),
    df AS (SELECT term, count(*) AS df FROM c GROUP BY term), x AS (SELECT query_id, path, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))) AS score FROM a JOIN df USING (term) JOIN c USING (term), s GROUP BY ALL),
    o AS (SELECT query_id, path, count(*) AS hits FROM (SELECT path, unnest(own) AS term FROM d) JOIN a USING (term) GROUP BY ALL),
    bm AS (SELECT query_id, path, round(score + 0.001::DOUBLE * coalesce(hits, 0), 6) AS score FROM x LEFT JOIN o USING (query_id, path) WHERE score > 0)"""


@query("a13_bm25", f"{BM25} SELECT query_id, path, score FROM bm")
def a13(spark, sf_dir):
    return baselines.bm25(doc_texts(spark, sf_dir), benchmark_tasks(spark, sf_dir))


@query("w01_ranked", f"{BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM bm) SELECT query_id, path, score, rank FROM r WHERE rank <= 10")
def w01(spark, sf_dir):
    return baselines.ranked(baselines.bm25(doc_texts(spark, sf_dir), benchmark_tasks(spark, sf_dir), 10), 10)


@query("a14_filename", rf"""WITH u AS (SELECT url AS path FROM pages), tk AS (SELECT p_partkey AS query_id, 'open ' || p_name || ' ' || p_size AS text FROM part),
    d AS (SELECT path, list_distinct({eval_words("regexp_replace(regexp_replace(path, '(?i)\\.[a-z0-9]+$', ''), '(^|/)(packages?|libs?|modules?|ts|js|src|lib)($|/|$)', ' ', 'g')")}) AS f, list_distinct({eval_words("regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.[a-z0-9]+$', ''), '(^|/)(packages?|libs?|modules?|ts|js|src|lib)($|/|$)', ' ', 'g')")}) AS b FROM u),
    w AS (SELECT path, term, CASE WHEN list_contains(b, term) THEN 2 ELSE 1 END AS w FROM (SELECT path, b, unnest(list_distinct(list_concat(f, b))) AS term FROM d)), df AS (SELECT term, count(*) AS df FROM w GROUP BY term), n AS (SELECT count(*) AS n FROM u),
    q AS (SELECT DISTINCT query_id, unnest({eval_words('text')}) AS term FROM tk) SELECT query_id, path, round(sum(w * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM q JOIN df USING (term) JOIN w USING (term), n GROUP BY ALL""")
def a14(spark, sf_dir):
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("open "), "p_name", F.lit(" "), "p_size").alias("text"))
    return baselines.filename(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), tasks)


@query("a15_random")
def a15(spark, sf_dir):
    return baselines.random_windows(doc_texts(spark, sf_dir).select("path"), benchmark_tasks(spark, sf_dir), config.EVAL_SEED, 10)


@query("a24_dedupe_text", "SELECT text, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def a24(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("a08_exact_symbols", f"""WITH s AS (SELECT 'lib/' || s_name || '.ts' AS path, n_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'function' WHEN s_suppkey % 3 = 1 THEN 'class' ELSE 'interface' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT count(*) AS n FROM supplier),
    d AS (SELECT name, count(*) AS df FROM s GROUP BY name) SELECT path, name, round(CASE kind WHEN 'function' THEN 1.0 WHEN 'class' THEN 0.9 ELSE 0.4 END::DOUBLE * least(1, ln(1 + n / df) / ln(1 + n)), 6) AS weight FROM s JOIN d USING (name), n""")
def a08(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "function").when(F.col("s_suppkey") % 3 == 1, "class").otherwise("interface")
    s = s.select(F.concat(F.lit("lib/"), "s_name", F.lit(".ts")).alias("path"), F.col("n_name").alias("name"), kind.alias("kind"))
    vocab = lexical.vocabulary(s.select(F.col("name").alias("term")), lexical.count_row(table(spark, sf_dir, "supplier"))).withColumnRenamed("term", "name")
    return s.join(vocab, "name").select("path", "name", F.round(X.exact_weight_for_kind(F.col("kind")) * lexical.specificity(F.col("idf"), F.col("max_idf")), 6).alias("weight"))


#: Retrieval over documents: words and, as they have no symbols and no edges, the folder of the best hit.
def retrieve_sql(fusion: float = 2.0, limit: int = 20, all_identifiers: bool = False) -> str:
    lex = LEX.replace(f"[1:{LEXICAL.identifiers}] AS u", " AS u") if all_identifiers else LEX
    return f"""{lex}, seed AS (SELECT query_id, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, path) AS k FROM lex WHERE round(weight, 6) > 0) WHERE k = 1),
    beside AS (SELECT s.query_id, d.path FROM seed s JOIN docs d ON regexp_replace(d.path, '/?[^/]*$', '') = regexp_replace(s.path, '/?[^/]*$', '') AND d.path <> s.path),
    sig AS (SELECT query_id, path, weight, weight AS content FROM lex UNION ALL SELECT query_id, path, 0.2::DOUBLE, 0 FROM beside),
    sc AS (SELECT query_id, path, round(sum(weight) + {fusion}::DOUBLE * sum(content), 6) AS score FROM sig GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INTEGER AS rank FROM sc WHERE score > 0),
    ranking AS (SELECT * FROM rk WHERE rank <= {limit})"""


@query("e01_retrieve", retrieve_sql() + " SELECT query_id, path, score, rank FROM ranking")
def e01(spark, sf_dir):
    return retrieve(corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir))[1].select("query_id", "path", "score", "rank")


@query("e11_without_fusion", retrieve_sql(0.0) + " SELECT query_id, path, score, rank FROM ranking")
def e11(spark, sf_dir):
    return retrieve(corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir), Retrieval(fusion=False))[1].select("query_id", "path", "score", "rank")


@query("w02_seeds", f"{LEX}, k AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, path)::INTEGER AS place FROM lex WHERE round(weight, 6) > 0) SELECT query_id, path, place FROM k WHERE place <= 5")
def w02(spark, sf_dir):
    from lodestone.plans.retrieve import content_scores

    q = benchmark_tasks(spark, sf_dir)
    return seeds_of(content_scores(content_signals(corpus(spark, sf_dir), q)), q, None).select("query_id", "path", "place")


@query("j15_same_directory", r"""WITH p AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), s AS (SELECT source || '/' || lang AS dir, min(source || '/' || lang || '/' || doc_id || '.md') AS seed FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL),
    r AS (SELECT dir AS query_id, path, row_number() OVER (PARTITION BY dir ORDER BY path) AS nth, seed FROM p JOIN s ON starts_with(p.path, dir || '/')) SELECT query_id, path FROM r WHERE nth <= 21 AND path <> seed""")
def j15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").select(lexical.document_path().alias("path"), F.concat_ws("/", "source", "lang").alias("dir"))
    seeds = d.groupBy("dir").agg(F.min("path").alias("path")).select(F.col("dir").alias("query_id"), "path", F.lit(1).alias("place"))
    return same_directory(d.select("path"), seeds, d.select(F.lit("").alias("query_id"), "path").limit(0)).select("query_id", "path")


@query("t23_explain", f"{retrieve_sql()} SELECT query_id, r.path, CASE WHEN b.path IS NULL THEN printf('Lexical match (score %.2f)', l.weight) WHEN l.path IS NULL THEN 'Same directory as top match: ' || regexp_replace(r.path, '/[^/]*$', '') WHEN l.weight >= 0.2 THEN printf('Lexical match (score %.2f)', l.weight) ELSE 'Same directory as top match: ' || regexp_replace(r.path, '/[^/]*$', '') END AS first_reason FROM ranking r LEFT JOIN lex l USING (query_id, path) LEFT JOIN beside b USING (query_id, path)")
def t23(spark, sf_dir):
    signals, ranking = retrieve(corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir))
    return explained(signals, ranking).select("query_id", "path", F.regexp_replace(F.element_at("reasons", 1), r"(\(score [0-9.]+\)):.*", "$1").alias("first_reason"))


@query("w15_recency", "WITH t AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), r AS (SELECT user_id, (row_number() OVER (ORDER BY last DESC, user_id) - 1)::INTEGER AS rank FROM t) SELECT user_id, rank, round(0.15::DOUBLE * (1 - rank / 25::DOUBLE), 6) AS weight FROM r WHERE rank < 25")
def w15(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    top = last.orderBy(F.desc("last"), "user_id").limit(RETRIEVAL.recency_ranks)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last"), "user_id")) - 1)
    return r.select("user_id", "rank", F.round(RETRIEVAL.recency * (1 - F.col("rank") / RETRIEVAL.recency_ranks), 6).alias("weight"))


@query("k02_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def k02(spark, sf_dir):
    from lodestone.operators.ranks import top

    return top(table(spark, sf_dir, "orders"), 3, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("k03_search_symbols", "WITH s AS (SELECT lower(replace(p_name, ' ', '')) AS canonical, p_partkey FROM part) SELECT canonical, p_partkey::VARCHAR AS symbol_id FROM s WHERE starts_with(canonical, 'a') ORDER BY canonical, p_partkey::VARCHAR LIMIT 50")
def k03(spark, sf_dir):
    from lodestone.operators.resolve import search_symbols

    names = table(spark, sf_dir, "part").select(X.canonical_term(F.col("p_name")).alias("canonical"), F.col("p_partkey").cast("string").alias("symbol_id"), F.lit("").alias("path"), F.lit(1).alias("line"))
    return search_symbols(names, "A", 50).select("canonical", "symbol_id")
