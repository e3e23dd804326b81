"""Queries of packaging, of the index on disk and of the change stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.config import Budget
from lodestone.operators import packing, security, seeds
from lodestone.plans import context
from lodestone.plans.base import DOCS, benchmark_tasks, doc_texts, query, table
from lodestone.plans.inline import Inline
from lodestone.plans.lexical_queries import corpus, retrieve_sql
from lodestone.plans.retrieve import explained, query_text, retrieve
from lodestone.plans.text_queries import BINARY, MAX, doc_files
from lodestone.sources import store
from lodestone.sources.shared import shared_dir, written
from lodestone.streaming import changes

TIERS = "CASE t WHEN 'USER_SELECTED' THEN 1 WHEN 'EXACT_SYMBOL' THEN 2 WHEN 'CHANGE_SEED' THEN 3 WHEN 'DIRECT_DEPENDENCY' THEN 4 WHEN 'DIRECT_DEPENDENT' THEN 5 WHEN 'RELEVANT_TESTS' THEN 6 WHEN 'STRONG_LEXICAL' THEN 7 WHEN 'ARCHITECTURAL' THEN 8 ELSE 9 END"
KINDS = ["EXACT_SYMBOL", "OPEN_EDITOR", "SEED_NEIGHBOR", "DIRECT_DEPENDENCY", "DIRECT_DEPENDENT", "TEST_OF", "CALL_EDGE", "HUB", "SELECTION"]
TIER_OF = ["EXACT_SYMBOL", "CHANGE_SEED", "STRONG_LEXICAL", "DIRECT_DEPENDENCY", "DIRECT_DEPENDENT", "RELEVANT_TESTS", "STRONG_LEXICAL", "ARCHITECTURAL", "LOWER_CONFIDENCE"]
RANKED = f"""rk0 AS (SELECT c_nationkey AS query_id, c_name AS path, round(c_acctbal, 2) AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name)::INTEGER AS rank, c_custkey % 10 = 0 AS pinned, CASE WHEN c_custkey % 10 = 0 THEN 'USER_SELECTED' ELSE {list(TIER_OF)}[c_custkey % 9 + 1] END AS t FROM customer)"""


def ranked(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("c_custkey") % 9 + 1).cast("int"))
    pinned = F.col("c_custkey") % 10 == 0
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_name")
    d = table(spark, sf_dir, "customer")
    return d.select(F.col("c_nationkey").alias("query_id"), F.col("c_name").alias("path"), F.round("c_acctbal", 2).alias("score"), F.row_number().over(w).alias("rank"), pinned.alias("pinned"), packing.tier(F.array(kind), pinned).alias("tier"))


@query("w03_tiers", f"WITH {RANKED} SELECT query_id, path, t AS tier, {TIERS} AS place FROM rk0")
def w03(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "path", "tier", packing.tier_order(F.col("tier")).alias("place"))


@query("w04_packing_order", f"WITH {RANKED} SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pinned THEN 0 WHEN rank <= 6 THEN 1 ELSE 2 END, CASE WHEN NOT pinned AND rank <= 6 THEN rank ELSE {TIERS} END, score DESC, path)::INTEGER AS ord FROM rk0")
def w04(spark, sf_dir):
    return packing.packing_order(ranked(spark, sf_dir)).select("query_id", "path", "ord")


@query("e16_tier_labels", f"WITH {RANKED} SELECT path, CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.TIERS.items()) + " END AS label FROM rk0")
def e16(spark, sf_dir):
    return ranked(spark, sf_dir).select("path", packing.tier_label(F.col("tier")).alias("label"))


SYMBOLS = "sy AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber::VARCHAR AS id, (l_partkey % 40 - 2)::INTEGER AS a, (l_partkey % 40 - 2 + l_suppkey % 6)::INTEGER AS b FROM lineitem)"
MERGED = f"""{SYMBOLS}, r0 AS (SELECT path, greatest(1, a) AS a, b FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY a, id) AS k FROM sy) WHERE k <= 20), r1 AS (SELECT * FROM r0 WHERE b >= a), r2 AS (SELECT *, max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r1),
    r3 AS (SELECT *, sum(CASE WHEN a <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM r2), mg AS (SELECT path, min(a) AS start, max(b) AS "end" FROM r3 GROUP BY path, i)"""


def line_symbols(spark, sf_dir):
    a = (F.col("l_partkey") % 40 - 2).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("id"), a.alias("start_line"), (a + F.col("l_suppkey") % 6).cast("int").alias("end_line"))


@query("w06_symbol_ranges", f'WITH {MERGED} SELECT path, start, "end" FROM mg')
def w06(spark, sf_dir):
    return packing.merge_ranges(line_symbols(spark, sf_dir))


@query("w07_line_allowance", f'WITH {MERGED}, q AS (SELECT *, 10 - coalesce(sum("end" - start + 1) OVER (PARTITION BY path ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM mg) SELECT path, start, least("end", start + l - 1)::INTEGER AS "end" FROM q WHERE l > 0')
def w07(spark, sf_dir):
    return packing.line_allowance(packing.merge_ranges(line_symbols(spark, sf_dir)), 10)


@query("e06_symbol_lines", "SELECT l_orderkey::VARCHAR AS path, l_linenumber AS line, 'function f' || l_partkey AS label FROM lineitem ORDER BY path, line, label LIMIT 300")
def e06(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("start_line"), F.lit("function").alias("kind"), F.concat(F.lit("f"), "l_partkey").alias("name"))
    return packing.symbol_lines(d)


CHANGED = "ch AS (SELECT c_custkey % 4 AS q, CASE WHEN c_custkey % 6 = 0 THEN 'dist/' ELSE 'src/' END || c_name || CASE WHEN c_custkey % 7 = 0 THEN '.min.js' ELSE '.ts' END AS path, ['staged', 'unstaged', 'untracked', 'deleted'][c_custkey % 4 + 1] AS state FROM customer)"


@query("w10_flood_control", f"WITH {CHANGED} SELECT path, state FROM ch WHERE NOT regexp_matches(lower(path), '{config.GENERATED_PATH}') ORDER BY CASE state WHEN 'staged' THEN 0 WHEN 'unstaged' THEN 1 WHEN 'untracked' THEN 2 ELSE 3 END, path LIMIT 25")
def w10(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.element_at(F.array(*[F.lit(s) for s in ("staged", "unstaged", "untracked", "deleted")]), (k % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "customer").select(F.concat(F.when(k % 6 == 0, "dist/").otherwise("src/"), "c_name", F.when(k % 7 == 0, ".min.js").otherwise(".ts")).alias("path"), state.alias("state"))
    return seeds.flood_control(d, 25)


@query("w16_seed_parts", "WITH d AS (SELECT o_custkey AS query_id, o_orderpriority AS path, split_part(o_orderstatus || chr(10) || o_orderkey, chr(10), 1) AS message FROM orders), u AS (SELECT DISTINCT * FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, message)::INTEGER AS ord FROM u) SELECT query_id, path, message, ord FROM r WHERE ord <= 20")
def w16(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("path"), F.concat("o_orderstatus", F.lit("\n"), "o_orderkey").alias("message"))
    return seeds.normalise_diagnostics(d)


@query("j16_seed_hints", "WITH s AS (SELECT o_custkey AS query_id, 'f' || o_orderkey % 30 AS path, ['STACK_FRAME', 'DIAGNOSTIC', 'OPEN_EDITOR', 'DIFF_TOUCHED', 'SELECTION'][o_orderkey % 5 + 1] AS kind, 5 - o_orderkey % 5 AS o FROM orders WHERE o_orderkey % 30 < 20) SELECT query_id, path, min_by(kind, o) AS kind FROM s GROUP BY ALL")
def j16(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(s) for s in ("STACK_FRAME", "DIAGNOSTIC", "OPEN_EDITOR", "DIFF_TOUCHED", "SELECTION")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 30).alias("path"), kind.alias("kind"), F.lit("").alias("detail"))
    return seeds.hints(s, spark.createDataFrame([(f"f{k}",) for k in range(20)], "path string")).select("query_id", "path", "kind")


RECENT = "rc AS (SELECT 'f' || user_id AS path, (row_number() OVER (ORDER BY max(ts) DESC, user_id) - 1)::INTEGER AS rank FROM events GROUP BY user_id)"


@query("j13_recency_join", f"WITH {RECENT}, s AS (SELECT DISTINCT 0 AS query_id, 'f' || o_custkey AS path FROM orders) SELECT query_id, path, round(0.15::DOUBLE * (1 - rank / 25::DOUBLE), 6) AS weight FROM s JOIN rc USING (path) WHERE rank < 25")
def j13(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id").limit(25)
    rc = last.select(F.concat(F.lit("f"), "user_id").alias("path"), (F.row_number().over(Window.orderBy(F.desc("ts"), "user_id")) - 1).alias("rank"))
    s = table(spark, sf_dir, "orders").select(F.lit(0).alias("query_id"), F.concat(F.lit("f"), "o_custkey").alias("path")).distinct()
    return s.join(rc, "path").select("query_id", "path", F.round(0.15 * (1 - F.col("rank") / 25), 6).alias("weight"))


@query("f01_eligible", f"WITH {DOCS} SELECT path FROM docs WHERE octet_length(encode(text)) <= {MAX} AND NOT {BINARY}")
def f01(spark, sf_dir):
    from lodestone.sources.scan import scan

    return scan(doc_files(spark, sf_dir), MAX).filter("status = 'OK'").select("path")


@query("f02_folder_scope", f"WITH {DOCS} SELECT path FROM docs WHERE path = 'src1/en' OR starts_with(path, 'src1/en/')")
def f02(spark, sf_dir):
    from lodestone.functions.paths import is_under

    return doc_texts(spark, sf_dir).select("path").filter(is_under(F.col("path"), F.lit("src1/en")))


@query("f06_frame_paths", "SELECT page_id, url FROM pages WHERE length(url) BETWEEN 1 AND 512 AND NOT regexp_matches(url, '(?i)^(node|https?|ext|data):') AND NOT starts_with(url, '<')")
def f06(spark, sf_dir):
    from lodestone.functions.paths import plausible_frame_path

    return table(spark, sf_dir, "pages").select("page_id", "url").filter(plausible_frame_path(F.col("url")))


@query("f07_positive_scores", f"{retrieve_sql(limit=60)} SELECT query_id, count(*)::BIGINT AS n FROM ranking WHERE score > 0 GROUP BY query_id")
def f07(spark, sf_dir):
    return retrieve(corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir), config.Retrieval(limit=60))[1].filter("score > 0").groupBy("query_id").agg(F.count("*").alias("n"))


@query("k01_limit", f"{retrieve_sql(limit=15, all_identifiers=True)} SELECT query_id, path, rank FROM ranking")
def k01(spark, sf_dir):
    """Over an index of all identifiers, however many a document holds."""
    return retrieve(corpus(spark, sf_dir, identifiers=None), benchmark_tasks(spark, sf_dir), config.Retrieval(limit=15))[1].select("query_id", "path", "rank")


@query("k05_pins", f"{retrieve_sql()}, p AS (SELECT query_id, 'pinned/' || k AS path, k FROM tasks, (VALUES ('a'), ('b')) t(k)) SELECT query_id, path, rank FROM ranking UNION ALL SELECT p.query_id, p.path, (coalesce((SELECT max(rank) FROM ranking r WHERE r.query_id = p.query_id), 0) + CASE k WHEN 'a' THEN 1 ELSE 2 END)::INTEGER FROM p")
def k05(spark, sf_dir):
    q = benchmark_tasks(spark, sf_dir)
    pins = q.select("query_id", F.explode(F.array(F.lit("pinned/a"), F.lit("pinned/b"))).alias("path"))
    return retrieve(corpus(spark, sf_dir), q, pins=pins)[1].select("query_id", "path", "rank")


# ---- packages ----

SMALL = Budget(max_files=6, max_chars=12_000, max_lines=400, max_tokens=3_000, max_lines_per_file=60)


def candidates(spark, sf_dir, limit=10):
    q = benchmark_tasks(spark, sf_dir)
    signals, ranking = retrieve(corpus(spark, sf_dir), q, config.Retrieval(limit=limit))
    d = written(explained(signals, ranking), "ranked").withColumn("pinned", F.lit(False)).withColumn("tier", packing.tier(F.col("kinds"), F.col("pinned")))
    none = F.array().cast("array<struct<id:string,kind:string,start_line:int,end_line:int,signature:string>>")
    return packing.packing_order(d).join(doc_texts(spark, sf_dir), "path").withColumn("symbols", none)


@query("w08_budget_ladder")
def w08(spark, sf_dir):
    return packing.pack(candidates(spark, sf_dir), SMALL).drop("section")


@query("e04_budget_holds", "SELECT item_id AS query_id, true AS holds FROM benchmark")
def e04(spark, sf_dir):
    p = packing.pack(candidates(spark, sf_dir), SMALL)
    kept = F.col("section").isNotNull()
    ok = (F.count_if(kept) <= SMALL.max_files) & (F.sum("chars") <= SMALL.max_chars) & (F.sum("lines") <= SMALL.max_lines) & (F.count("*") == F.count_if(kept) + F.count_if(F.col("note").isNotNull()))
    per = p.groupBy("query_id").agg(ok.alias("holds"))
    return benchmark_tasks(spark, sf_dir).select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("holds", F.lit(True)).alias("holds"))


@query("e05_why_rows")
def e05(spark, sf_dir):
    c = candidates(spark, sf_dir)
    d = doc_texts(spark, sf_dir)
    return packing.why_rows(c, packing.pack(c, SMALL), security.verdicts(d, security.find(d)))


@query("e03_screened")
def e03(spark, sf_dir):
    """Each candidate's text is read once, screened, and redacted before anything is packed."""
    c = candidates(spark, sf_dir)
    texts = written(c.select("path", "text").distinct(), "snapshot")
    found = written(security.find(texts), "findings")
    safe = security.redact(texts, security.merge_spans(found.select("path", "start", "end", "kind")))
    packed = packing.pack(c.drop("text").join(safe, "path"), SMALL)
    return packed.groupBy("level").agg(F.count("*").alias("n"))


@query("e07_static_reserve", "SELECT * FROM (VALUES (0, 10::BIGINT, 1::BIGINT), (5, 330::BIGINT, 41::BIGINT)) t(eligible, chars, lines)")
def e07(spark, sf_dir):
    return spark.createDataFrame([(n, *packing.reserve("# heading\n", n)) for n in (0, 5)], "eligible int, chars long, lines long")


@query("e02_modes", "SELECT * FROM (VALUES ('task', 'fix the login'), ('file', 'session'), ('selection', 'why openSession()'), ('project', '')) t(mode, text)")
def e02(spark, sf_dir):
    rows = [("task", query_text("task", task="fix the login")), ("file", query_text("file", task="x", path="src/session.ts")), ("selection", query_text("selection", task="why", selection="openSession()")), ("project", query_text("project"))]
    return spark.createDataFrame(rows, "mode string, text string")


@query("s28_payload")
def s28(spark, sf_dir):
    return context.packages(spark, corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir), doc_texts(spark, sf_dir))


@query("s29_payload_round_trip", "SELECT item_id AS query_id, true AS same FROM benchmark")
def s29(spark, sf_dir):
    """Whether the files read from a package are those that were put in, in the same order, for every task."""
    p = written(context.packages(spark, corpus(spark, sf_dir), benchmark_tasks(spark, sf_dir), doc_texts(spark, sf_dir)), "payloads")
    got = packing.package_files(p.select(F.col("query_id").alias("payload_id"), F.col("payload").alias("text"))).groupBy(F.col("payload_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("got"))
    d = p.select("query_id", "files").join(got, "query_id", "left").select("query_id", (F.coalesce(F.transform("got", lambda x: x["path"]), F.array().cast("array<string>")) == F.col("files")).alias("same"))
    return benchmark_tasks(spark, sf_dir).select("query_id").join(d, "query_id", "left").withColumn("same", F.coalesce("same", F.lit(False)))


@query("w09_settled_tokens")
def w09(spark, sf_dir):
    text, tokens = packing.settle_tokens(lambda n: f"~{n} " + "word " * 900)
    _, kept = packing.degrade([{"n": 600}, {"n": 600}], lambda s: "x" * (100 + sum(k["n"] for k in s)), Budget(max_chars=1000))
    return spark.createDataFrame([(tokens, len(text), len(kept))], "tokens int, chars int, kept int")


@query("w11_diff_share", "SELECT * FROM (VALUES ('a', 8), ('b', 10)) t(path, chars)")
def w11(spark, sf_dir):
    kept, _ = packing.share_of_changes([("a", "one\ntwo\nthree\n"), ("b", "long line\n"), ("c", "there is no line end in here")], 9)
    return spark.createDataFrame([(p, len(t)) for p, t in kept], "path string, chars int")


@query("t19_cut_at_line", "SELECT * FROM (VALUES (0, ''), (5, 'one' || chr(10)), (9, 'one' || chr(10) || 'zwö' || chr(10)), (99, 'one' || chr(10) || 'zwö' || chr(10) || 'end')) t(bytes, text)")
def t19(spark, sf_dir):
    return spark.createDataFrame([(n, seeds.cut_at_line("one\nzwö\nend", n)) for n in (0, 5, 9, 99)], "bytes int, text string")


@query("e15_budget_checks", "SELECT * FROM (VALUES ('max_files', true), ('max_chars', true), ('tree_depth', true), ('change_tokens', false)) t(name, refused)")
def e15(spark, sf_dir):
    def refused(**k) -> bool:
        try:
            Budget(**k)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([("max_files", refused(max_files=0)), ("max_chars", refused(max_chars=999)), ("tree_depth", refused(tree_depth=0)), ("change_tokens", refused(change_tokens=0))], "name string, refused boolean")


# ---- index and stream ----


def index_of(spark, sf_dir):
    """The index as it was and the files as they are: some documents changed, some are new, some are gone."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id")
    old = d.filter("doc_id % 7 <> 1").select("path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("doc_id") % 11 == 0).alias("transient_failure"))
    return d.filter("doc_id % 6 <> 2").select("path", "content_hash"), old


@query("j19_change_detection", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 6 = 2 THEN 'removed' WHEN doc_id % 7 <> 1 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 THEN 'reuse' ELSE 'reparse' END AS action FROM documents WHERE doc_id IS NOT NULL AND (doc_id % 6 <> 2 OR doc_id % 7 <> 1)")
def j19(spark, sf_dir):
    return changes.diff_index(*index_of(spark, sf_dir))


@query("a30_status_counts", "WITH a AS (SELECT CASE WHEN doc_id % 6 = 2 THEN 'removed' WHEN doc_id % 7 <> 1 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 THEN 'reuse' ELSE 'reparse' END AS action FROM documents WHERE doc_id IS NOT NULL AND (doc_id % 6 <> 2 OR doc_id % 7 <> 1)) SELECT count(*) FILTER (action <> 'removed')::BIGINT AS total, count(*) FILTER (action = 'reparse')::BIGINT AS reparsed, count(*) FILTER (action = 'reuse')::BIGINT AS reused, count(*) FILTER (action = 'removed')::BIGINT AS removed FROM a")
def a30(spark, sf_dir):
    return changes.status_counts(changes.diff_index(*index_of(spark, sf_dir)))


def change_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), F.col("user_id") % 40).alias("path"), F.when(F.col("event_type") == "view", "change").when(F.col("event_type") == "click", "create").otherwise("delete").alias("kind"))


EVENTS = "ev AS (SELECT ts, 'f' || user_id % 40 AS path, CASE event_type WHEN 'view' THEN 'change' WHEN 'click' THEN 'create' ELSE 'delete' END AS kind FROM events)"


@query("st02_coalesced", f"WITH {EVENTS} SELECT path, arg_max(kind, (ts, kind)) AS kind FROM ev GROUP BY path")
def st02(spark, sf_dir):
    return changes.coalesced(change_events(spark, sf_dir)).select("path", "kind")


BURST = Inline("b", "ms int, path string, kind string", [(0, "a", "create"), (100, "b", "change"), (500, "a", "change"), (600, "c", "change"), (601, "a", "delete"), (1300, "b", "change"), (5000, "c", "delete")])


@query("st02_flushes", "SELECT * FROM (VALUES (1, 'a', 'change'), (1, 'b', 'change'), (1, 'c', 'change'), (2, 'a', 'delete'), (3, 'b', 'change'), (4, 'c', 'delete')) t(flush, path, kind)")
def st02b(spark, sf_dir):
    d = BURST.df(spark).select(F.timestamp_millis(F.col("ms") + 1_000_000).alias("ts"), "path", "kind", F.lit("w").alias("workspace"))
    return changes.flushes(d, 600, ["workspace"]).select("flush", "path", "kind")


@query("st03_refresh_by_key", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 6 = 2 THEN 'remove' ELSE 'upsert' END AS action FROM documents WHERE CASE WHEN doc_id % 6 = 2 THEN doc_id % 7 <> 1 ELSE doc_id % 7 = 1 OR doc_id % 5 = 0 END")
def st03(spark, sf_dir):
    now, old = index_of(spark, sf_dir)
    e = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit("delete").alias("kind"))
    up, gone = changes.apply_changes(e, now, old)
    return up.select("path", F.lit("upsert").alias("action")).unionByName(gone.select("path", F.lit("remove").alias("action")))


@query("st04_rescan", "SELECT true AS with_ignore_file, false AS without")
def st04(spark, sf_dir):
    c = spark.createDataFrame([("a/.gitignore", "change"), ("b.ts", "change")], "path string, kind string")
    return spark.createDataFrame([(changes.needs_rescan(c), changes.needs_rescan(c.filter("path = 'b.ts'")))], "with_ignore_file boolean, without boolean")


@query("st06_stream_equals_batch", "SELECT user_id % 40 AS f, count(*)::BIGINT AS n FROM (SELECT DISTINCT 'f' || user_id % 40 AS p, user_id % 40 AS user_id FROM events) GROUP BY ALL")
def st06(spark, sf_dir):
    """The events replayed as a stream of two files, coalesced batch by batch, against one table."""
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = change_events(spark, sf_dir)
    events.repartition(2, "path").write.parquet(f"{at}/in")
    out = f"{at}/out"

    def publish(up, gone):
        up.select("path").write.mode("append").parquet(out)

    now = events.select("path").distinct().withColumn("content_hash", F.sha2("path", 256))
    seen = spark.createDataFrame([], "path string, content_hash string")
    changes.run_index(changes.change_stream(spark, f"{at}/in", 1), f"{at}/cp", lambda: now, lambda: seen, publish).awaitTermination(120)
    return spark.read.parquet(out).distinct().groupBy(F.substring("path", 2, 9).cast("long").alias("f")).agg(F.count("*").alias("n"))


def entry_rows(spark, n: int, salt: str = ""):
    d = spark.range(n).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256).alias("content_hash"), F.lit(False).alias("is_test"), F.lit("PARSED").alias("parse_status"))
    from pyspark.sql.types import ArrayType

    schema = spark.createDataFrame([], store.ENTRY).schema
    for f in schema.fields[5:]:
        d = d.withColumn(f.name, F.array().cast(f.dataType) if isinstance(f.dataType, ArrayType) else F.lit(None).cast(f.dataType))
    return d.select(*schema.names)


def document_entries(spark, sf_dir):
    """An entry for each document with an id."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    d = d.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    d = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), F.sha2("text", 256).alias("content_hash"), F.lit(False).alias("is_test"), F.lit("PARSED").alias("parse_status"))
    return d.crossJoin(F.broadcast(entry_rows(spark, 1).drop("path", "language", "content_hash", "is_test", "parse_status")))  # one row


@query("s14_store", "SELECT doc_id || '.md' AS path, sha256(max(coalesce(text, '')) || CASE WHEN doc_id % 7 = 3 THEN 'new' ELSE '' END) AS content_hash FROM documents WHERE doc_id IS NOT NULL AND doc_id % 5 <> 2 GROUP BY doc_id")
def s14(spark, sf_dir):
    """Every document stored; then some with another text, some removed."""
    import uuid

    s = store.EntryStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    e = document_entries(spark, sf_dir)
    s.upsert(e.drop("doc_id"))
    text = table(spark, sf_dir, "documents").filter("doc_id % 7 = 3").groupBy("doc_id").agg(F.sha2(F.concat(F.max(F.coalesce("text", F.lit(""))), F.lit("new")), 256).alias("content_hash"))
    s.upsert(e.drop("content_hash").join(text, "doc_id").filter("doc_id % 5 <> 2").drop("doc_id"), e.filter("doc_id % 5 = 2").select("path"))
    return s.load().select("path", "content_hash")


@query("s15_valid_entries", "SELECT doc_id || '.md' AS path, bool_and(doc_id % 3 <> 0 AND doc_id % 4 <> 1) AS valid FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id")
def s15(spark, sf_dir):
    """Entries of all documents, some with a damaged hash, some without a part that an entry must have."""
    e = document_entries(spark, sf_dir)
    e = e.withColumns({"content_hash": F.when(F.col("doc_id") % 3 == 0, "damaged").otherwise(F.col("content_hash")), "imports": F.when(F.col("doc_id") % 4 != 1, F.col("imports"))})
    return e.select("path", store.valid_entry().alias("valid"))


@query("e08_index_run", "SELECT 6::BIGINT AS entries, 6::BIGINT AS reused, true AS has_edges")
def e08(spark, sf_dir):
    from lodestone.plans.code_queries import sources
    from lodestone.plans.index import index_run

    first, edges = index_run(sources(spark))
    again = changes.diff_index(sources(spark).select("path", F.sha2("text", 256).alias("content_hash")), first.select("path", "content_hash", F.lit(False).alias("transient_failure")))
    n = again.agg(F.count_if(F.col("action") == "reuse").alias("reused"))
    return first.agg(F.count("*").alias("entries")).crossJoin(n).crossJoin(edges.agg((F.count("*") > 0).alias("has_edges")))
