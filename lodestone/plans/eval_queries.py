"""Queries of the evaluation: gold, metrics, comparisons, statistics, mining of commits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text as X
from lodestone.operators import baselines, metrics, mining, ranks, stats
from lodestone.operators.lexical import document_path
from lodestone.plans.base import DOCS, benchmark_tasks, doc_texts, listed, query, table
from lodestone.plans.inline import Inline
from lodestone.plans.lexical_queries import BM25, corpus, retrieve_sql
from lodestone.plans.retrieve import retrieve
from lodestone.plans.simulate import simulate
from lodestone.sources import history
from lodestone.sources.shared import written

GOLD = "gold AS (SELECT item_id AS task_id, path FROM benchmark b JOIN docs d ON contains(d.text, b.text))"


def gold_of(spark, sf_dir):
    """task_id, path: documents that hold an item's text. Items are cut to a beginning of 40 characters, looked up
    among the same cuts of the documents at word starts, so no product of items and documents is made."""
    items = table(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").alias("task_id"), F.col("text").alias("needle"))
    words = lambda c: F.split(c, r"\s+")
    key = lambda w: F.array_join(F.slice(w, 2, 4), " ")  # noqa: E731  the first word may be part of a longer one
    left = items.withColumn("k", key(words(F.col("needle")))).withColumn("n", F.size(words(F.col("needle"))))
    d = doc_texts(spark, sf_dir).withColumn("w", words(F.col("text")))
    starts = d.select("path", F.explode(F.array_distinct(F.transform(F.slice(F.col("w"), F.lit(1), F.greatest(F.lit(0), F.size("w") - 3)), lambda _, i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(4)), " ")))).alias("k"))
    pairs = starts.join(left.filter("n > 5"), "k").select("path", "task_id", "needle").distinct()
    long = pairs.join(d.select("path", "text"), "path").filter(F.contains(F.col("text"), F.col("needle"))).select("task_id", "path")
    short = left.filter("n <= 5").join(d, F.contains(F.col("text"), F.col("needle"))).select("task_id", "path")
    return long.unionByName(short)


RUNS = f"""{retrieve_sql(limit=50)}, {GOLD}, okapi AS ({BM25} SELECT query_id, path, score FROM bm), bmr AS (SELECT * FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM okapi) WHERE rank <= 50),
    runs AS (SELECT 'hybrid' AS system, query_id AS task_id, path, rank FROM ranking UNION ALL SELECT 'bm25', query_id, path, rank FROM bmr), systems AS (SELECT DISTINCT system FROM runs),
    gr AS (SELECT s.system, g.task_id, g.path, r.rank::INTEGER AS rank FROM gold g CROSS JOIN systems s LEFT JOIN runs r USING (system, task_id, path)),
    tm0 AS (SELECT system, task_id, count(*) AS n, min(rank) AS best, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 8) AS h8, count(*) FILTER (rank <= 10) AS h10 FROM gr GROUP BY ALL),
    tm AS (SELECT s.system, b.item_id AS task_id, CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS top1, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h5 / n END AS recall5, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h8 / n END AS recall8, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h10 / n END AS recall10,
      CASE WHEN n IS NULL OR h10 = n THEN 1.0 ELSE 0.0 END::DOUBLE AS all_gold10, coalesce(1.0::DOUBLE / best, 0) AS mrr FROM benchmark b CROSS JOIN systems s LEFT JOIN tm0 t ON t.system = s.system AND t.task_id = b.item_id)"""
_CACHE: dict = {}


def runs(spark, sf_dir):
    """system, task_id, path, rank of both systems, and the gold; written once for each session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _CACHE:
        q = benchmark_tasks(spark, sf_dir)
        hybrid = retrieve(corpus(spark, sf_dir), q, config.Retrieval(limit=config.EVAL_LIMIT))[1].select(F.lit("hybrid").alias("system"), F.col("query_id").alias("task_id"), "path", "rank")
        plain = baselines.ranked(baselines.bm25(doc_texts(spark, sf_dir), q, config.EVAL_LIMIT), config.EVAL_LIMIT).select(F.lit("bm25").alias("system"), F.col("query_id").alias("task_id"), "path", "rank")
        _CACHE[at] = written(hybrid.unionByName(plain), "runs"), written(gold_of(spark, sf_dir), "gold")
    return _CACHE[at]


def per_task(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"))
    return metrics.task_metrics(tasks, metrics.gold_ranks(gold, r))


@query("j24_gold_ranks", f"{RUNS} SELECT system, task_id, path, rank FROM gr")
def j24(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    return metrics.gold_ranks(gold, r)


M = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.MEASURES)


@query("a19_task_metrics", f"{RUNS} SELECT system, task_id, {M} FROM tm")
def a19(spark, sf_dir):
    return per_task(spark, sf_dir).select("system", "task_id", *[F.round(m, 6).alias(m) for m in metrics.MEASURES])


@query("e14_summary", f"{RUNS} SELECT system, 'full' AS slice, count(*)::BIGINT AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics.MEASURES)} FROM tm GROUP BY system UNION ALL SELECT system, 'even', count(*)::BIGINT, {', '.join(f'round(avg({m}), 6)' for m in metrics.MEASURES)} FROM tm WHERE task_id % 2 = 0 GROUP BY system")
def e14(spark, sf_dir):
    d = per_task(spark, sf_dir)
    both = d.withColumn("slice", F.explode(F.when(F.col("task_id") % 2 == 0, F.array(F.lit("full"), F.lit("even"))).otherwise(F.array(F.lit("full")))))
    return metrics.summarise(both, ["system", "slice"])


@query("e09_evaluation", f"{RUNS} SELECT system, count(*)::BIGINT AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in metrics.MEASURES)} FROM tm WHERE task_id IN (SELECT task_id FROM gold) GROUP BY system")
def e09(spark, sf_dir):
    _, gold = runs(spark, sf_dir)
    return metrics.summarise(per_task(spark, sf_dir).join(gold.select("task_id").distinct(), "task_id", "left_semi"), ["system"])


@query("a20_package_recall", f"{RUNS} SELECT system, task_id, round(count(*) FILTER (rank <= 8) / count(*), 6) AS package_recall FROM gr GROUP BY ALL")
def a20(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    return metrics.package_recall(gold, r.filter("rank <= 8")).withColumn("package_recall", F.round("package_recall", 6))


@query("j25_paired_runs", f"{RUNS} SELECT a.task_id, round(a.mrr, 6) AS a, round(b.mrr, 6) AS b, round(a.mrr - b.mrr, 6) AS diff FROM tm a JOIN tm b USING (task_id) WHERE a.system = 'hybrid' AND b.system = 'bm25'")
def j25(spark, sf_dir):
    d = written(per_task(spark, sf_dir), "per-task")
    p = metrics.paired(d.filter("system = 'hybrid'"), d.filter("system = 'bm25'"), "mrr")
    return p.select("task_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "diff")])


@query("j27_gaps", f"{RUNS} SELECT g.task_id, g.path, b.rank AS baseline_rank, g.rank AS system_rank FROM gr g JOIN gr b USING (task_id, path) WHERE g.system = 'bm25' AND b.system = 'hybrid' AND (g.rank IS NULL OR g.rank > 10) AND g.task_id IN (SELECT task_id FROM tm WHERE system = 'hybrid' AND all_gold10 = 1) AND g.task_id NOT IN (SELECT task_id FROM tm WHERE system = 'bm25' AND all_gold10 = 1)")
def j27(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    return metrics.gaps(per_task(spark, sf_dir), metrics.gold_ranks(gold, r), "bm25", "hybrid")


@query("k04_case_studies", f"{RUNS}, k AS (SELECT system, task_id, row_number() OVER (PARTITION BY system ORDER BY mrr DESC, recall10 DESC, task_id)::INTEGER AS b, row_number() OVER (PARTITION BY system ORDER BY mrr, recall10, task_id)::INTEGER AS w FROM tm) SELECT system, 'best' AS side, b AS place, task_id FROM k WHERE b <= 5 UNION ALL SELECT system, 'worst', w, task_id FROM k WHERE w <= 5")
def k04(spark, sf_dir):
    return metrics.case_studies(written(per_task(spark, sf_dir), "per-task"))


@query("a26_gap_buckets", f"{RUNS}, n AS (SELECT task_id, count(*) AS g FROM gold GROUP BY ALL) SELECT system, CASE WHEN task_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, CASE WHEN g >= 4 THEN '4+' ELSE g::VARCHAR END AS bucket, count(*)::BIGINT AS n, round(avg(recall5), 6) AS recall5, round(avg(recall8), 6) AS recall8, round(avg(recall10), 6) AS recall10 FROM tm JOIN n USING (task_id) GROUP BY ALL")
def a26(spark, sf_dir):
    _, gold = runs(spark, sf_dir)
    slices = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("slice"))
    return metrics.gap_buckets(per_task(spark, sf_dir), gold, slices)


@query("a25_loss_stages", f"{RUNS}, s AS (SELECT system, CASE WHEN rank IS NULL THEN 'not-in-candidates' WHEN rank > 8 THEN 'ranked-outside-top8' WHEN rank <= 4 THEN 'delivered' ELSE 'top8-not-packaged' END AS stage, path LIKE '%1.md' AS t FROM gr) SELECT stage, count(*)::BIGINT AS n, count(*) FILTER (t)::BIGINT AS n_test, count(*) FILTER (NOT t)::BIGINT AS n_other FROM s GROUP BY stage")
def a25(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    g = metrics.gold_ranks(gold, r)
    stage = metrics.loss_stage(F.lit(True), F.lit(False), F.coalesce(F.col("rank") <= 4, F.lit(False)), F.col("rank"), F.lit(False))
    return metrics.loss_table(g.select(stage.alias("stage"), F.col("path").endswith("1.md").alias("is_test")))


@query("a28_field_overlap", f"WITH {DOCS}, t AS (SELECT p_partkey, string_split(p_name, ' ') AS w, [lower(p_type)] AS i, [split_part(p_name, ' ', 2)] AS b FROM part) SELECT p_partkey, CASE WHEN len(list_intersect(w, i)) > 0 THEN 'indexed-overlap' WHEN len(list_intersect(list_filter(w, lambda x: NOT list_contains(i, x)), b)) > 0 AND p_partkey % 3 > 0 THEN 'body-only' ELSE 'neither' END AS verdict FROM t")
def a28(spark, sf_dir):
    w = F.split("p_name", " ")
    body = F.when(F.col("p_partkey") % 3 > 0, F.array(F.element_at(w, 2))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf_dir, "part").select("p_partkey", w.alias("task_words"), F.array(F.lower("p_type")).alias("indexed_words"), body.alias("body_words"))
    return metrics.field_overlap(d).select("p_partkey", "verdict")


@query("a27_lower_median", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS median FROM orders GROUP BY o_orderpriority")
def a27(spark, sf_dir):
    return metrics.lower_median(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])


@query("u03_gold_in_top", f"{RUNS} SELECT system, task_id, count(*)::BIGINT AS n FROM gr WHERE rank <= 10 GROUP BY ALL")
def u03(spark, sf_dir):
    r, gold = runs(spark, sf_dir)
    return r.filter("rank <= 10").join(gold, ["task_id", "path"], "left_semi").groupBy("system", "task_id").agg(F.count("*").alias("n"))


@query("u01_union_signals", "SELECT doc_id, 'quality' AS kind FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def u01(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.filter("quality = 1").select("doc_id", F.lit("quality").alias("kind")).unionByName(lab.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("kind")))


@query("u02_except", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def u02(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("w12_time_split", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS k, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN k <= floor(n / 2) THEN 'tuning' ELSE 'eval' END AS half FROM r")
def w12(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("committer_time"), F.col("event_id").alias("sha"))
    return stats.time_split(e).select("event_id", "half")


@query("w01_global_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)::BIGINT AS rank FROM lineitem")
def w01_global(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return ranks.global_rank(d, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], descending=True).select("l_orderkey", "l_linenumber", "rank")


@query("a21_bootstrap")
def a21(spark, sf_dir):
    d = per_task(spark, sf_dir)
    return stats.intervals(d, ["system"], "recall10", config.EVAL_SEED)


@query("a22_paired_bootstrap")
def a22(spark, sf_dir):
    d = written(per_task(spark, sf_dir), "per-task")
    return stats.paired_interval(d.filter("system = 'hybrid'"), d.filter("system = 'bm25'"), "recall10", config.EVAL_SEED)


@query("w13_reveal")
def w13(spark, sf_dir):
    _, gold = runs(spark, sf_dir)
    return stats.reveal(gold.select(F.col("task_id").cast("string").alias("task_id"), "path"))


@query("e10_seed_simulation")
def e10(spark, sf_dir):
    """Hidden-gold recall of nine arms, with the files that a task reveals taken out of every ranking."""
    gold = written(gold_of(spark, sf_dir).select(F.col("task_id").cast("string").alias("task_id"), "path"), "gold")
    tasks = benchmark_tasks(spark, sf_dir).select(F.col("query_id").cast("string").alias("task_id"), "text")
    r = written(simulate(corpus(spark, sf_dir), doc_texts(spark, sf_dir), tasks, gold, cfg=config.Retrieval(limit=config.EVAL_LIMIT)), "arms")
    hidden = stats.reveal(gold).filter(~F.col("revealed")).select("task_id", "path")
    return metrics.summarise(metrics.task_metrics(hidden.select("task_id").distinct(), metrics.gold_ranks(hidden, r)), ["system"])


@query("a15_random_exact")
def a15x(spark, sf_dir):
    """Each task ranks the documents of one source, its snapshot; all tasks, all sources."""
    d = table(spark, sf_dir, "documents").select(document_path().alias("path"), F.coalesce("source", F.lit("none")).alias("source"))
    n = d.select("source").distinct().orderBy("source").withColumn("source_no", F.row_number().over(Window.orderBy("source")) - 1)
    tasks = benchmark_tasks(spark, sf_dir).select(F.col("query_id").alias("task_id")).crossJoin(n.agg(F.count("*").alias("n")))
    snap = tasks.withColumn("source_no", (F.col("task_id") % F.col("n")).cast("int")).join(n, "source_no").join(d, "source").select("task_id", "path")
    return stats.random_ranking(snap, benchmark_tasks(spark, sf_dir).withColumnRenamed("query_id", "task_id"), config.EVAL_SEED)


# ---- commits: small tables written out in both languages ----

COMMITS = Inline(
    "commits", "sha string, n_parents int, author string, email string, ts bigint, subject string, body string, files string",
    [
        ("a1", 1, "Ann", "ann@x.org", 100, "Retry the upload when the server closes early", "", "M:src/up.ts:src/up.ts"),
        ("a2", 2, "Ann", "ann@x.org", 101, "Merge branch one into the other branch", "", "M:src/up.ts:src/up.ts"),
        ("a3", 1, "renovate", "bot@x.org", 102, "Update all the dependencies of this project", "", "M:package.json:package.json"),
        ("a4", 1, "Bob", "bob@x.org", 103, "Rename the helper module to something better", "", "R:src/a.ts:src/b.ts"),
        ("a5", 1, "Bob", "bob@x.org", 104, "Add a brand new parser for yaml files", "", "A:src/y.ts:src/y.ts"),
        ("a6", 1, "Bob", "bob@x.org", 105, "Revert the caching layer of the http client", "", "M:src/http.ts:src/http.ts"),
        ("a7", 1, "Cid", "cid@x.org", 106, "bump version to the next minor release 1.4.0", "", "M:package.json:package.json"),
        ("a8", 1, "Cid", "cid@x.org", 107, "Run prettier over the docs and the readme", "", "M:README.md:README.md"),
        ("a9", 1, "Cid", "cid@x.org", 108, "Explain how the plugin loads its configuration", "", "M:docs/guide.md:docs/guide.md"),
        ("b1", 1, "Dee", "dee@x.org", 109, "Pin the lock file for reproducible builds here", "", "M:yarn.lock:yarn.lock"),
        ("b2", 1, "Dee", "dee@x.org", 110, "Speed up the build pipeline on slow machines", "", "M:.github/ci.yml:.github/ci.yml"),
        ("b3", 1, "Dee", "dee@x.org", 111, "Replace the logo image with the new one", "", "M:logo.png:logo.png"),
        ("b4", 1, "Dee", "dee@x.org", 112, "Tidy up", "", "M:src/t.ts:src/t.ts"),
        ("b5", 1, "Eve", "eve@x.org", 113, "Retry the upload when the server closes early", "", "M:src/up2.ts:src/up2.ts"),
        ("b6", 1, "Eve", "eve@x.org", 114, "Touch very many files in one single commit", "", ";".join(f"M:src/f{k}.ts:src/f{k}.ts" for k in range(9))),
        ("b7", 1, "Eve", "eve@x.org", 115, "Nothing was changed by this commit at all", "", ""),
        ("b8", 1, "Fay", "fay@x.org", 116, "Check the order of the tests before running", "", "M:tests/o.test.ts:tests/o.test.ts"),
    ],
)
REASONS = {"a2": "merge-commit", "a3": "bot-author", "a4": "pure-rename", "a5": "no-localizable-gold", "a6": "revert", "a7": "version-bump", "a8": "format-only", "a9": "docs-only", "b1": "lockfile-only", "b2": "ci-only", "b3": "no-source-file", "b4": "task-too-short", "b6": "file-count", "b7": "file-count", "b8": "no-source-file"}


def commits(spark, rows=None):
    f = F.transform(F.filter(F.split("files", ";"), lambda x: x != ""), lambda x: F.struct(F.element_at(F.split(x, ":"), 1).alias("status"), F.element_at(F.split(x, ":"), 2).alias("pre_path"), F.element_at(F.split(x, ":"), 3).alias("post_path")))
    d = COMMITS.df(spark) if rows is None else rows
    return d.select("sha", F.array_repeat(F.lit("p"), F.col("n_parents")).alias("parents"), F.col("author").alias("author_name"), F.col("email").alias("author_email"), F.col("ts").alias("committer_time"), "subject", "body", f.alias("files"))


def _rules() -> str:
    paths = "list_transform(fs, lambda x: split_part(x, ':', 2))"
    no = lambda pattern: f"len(list_filter({paths}, lambda p: regexp_matches(p, '{pattern}'))) = 0"
    every = lambda pattern: f"len(list_filter({paths}, lambda p: NOT regexp_matches(p, '{pattern}'))) = 0"
    lock = r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in config.LOCKFILES) + ")$"
    src = r"\.[cm]?[jt]sx?$"
    return f"""CASE WHEN n_parents <> 1 THEN 'merge-commit' WHEN len(list_filter({list(config.BOT_MARKS)}, lambda b: contains(lower(author || ' ' || email), b))) > 0 THEN 'bot-author' WHEN len(fs) = 0 THEN 'file-count'
      WHEN len(list_filter(fs, lambda x: x[1] <> 'R')) = 0 THEN 'pure-rename' WHEN len(list_filter(fs, lambda x: x[1] NOT IN ('A', 'C'))) = 0 THEN 'no-localizable-gold' WHEN len(fs) > 8 THEN 'file-count'
      WHEN regexp_matches(subject, '{config.REVERT_SUBJECT}') THEN 'revert' WHEN regexp_matches(subject, '{config.VERSION_SUBJECT}') AND {every('(package|tsconfig)\\.json$|' + lock)} THEN 'version-bump'
      WHEN regexp_matches(subject, '{config.FORMAT_SUBJECT}') AND {no(src)} THEN 'format-only' WHEN {no(src)} AND NOT {no(lock)} THEN 'lockfile-only' WHEN {every(config.DOCS_PATH)} THEN 'docs-only' WHEN {no(src)} AND {every(config.CI_PATH)} THEN 'ci-only'
      WHEN len(list_filter({paths}, lambda p: regexp_matches(p, '{src}') AND NOT regexp_matches(p, '{config.TEST_PATH}'))) = 0 THEN 'no-source-file' WHEN len(list_filter(string_split(lower(subject), ' '), lambda w: w NOT IN {listed(config.EVAL_STOPWORDS)})) < 5 THEN 'task-too-short' END"""


JUDGED = f"{COMMITS.sql()}, c1 AS (SELECT *, list_filter(string_split(files, ';'), lambda x: x <> '') AS fs FROM commits), judged AS (SELECT *, {_rules()} AS reason FROM c1)"


@query("f05_commit_filter", f"WITH {JUDGED} SELECT sha, reason FROM judged")
def f05(spark, sf_dir):
    return mining.judge(commits(spark)).select("sha", "reason")


@query("a23_funnel", f"WITH {JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM judged GROUP BY ALL")
def a23(spark, sf_dir):
    return mining.funnel(mining.judge(commits(spark)))


@query("e13_dataset", f"WITH {JUDGED}, k AS (SELECT subject AS task, min(sha) AS sha FROM judged WHERE reason IS NULL GROUP BY subject) SELECT task, sha FROM k")
def e13(spark, sf_dir):
    kept = mining.judge(commits(spark)).filter("reason is null").select("task", "committer_time", "sha")
    return mining.first_of_text(kept, "task", ["committer_time", "sha"]).select("task", "sha")


_K = "o_orderkey"
_SUBJECT = f"CASE {_K} % 7 WHEN 0 THEN 'Revert the caching layer of order ' || {_K} WHEN 1 THEN 'Bump version for the release number ' || {_K} WHEN 2 THEN 'Format all files of the order module again' WHEN 3 THEN 'Tidy up' ELSE 'Correct the shipping address of order ' || {_K} || ' before sending goods' END"
_FILES = f"CASE {_K} % 9 WHEN 0 THEN 'M:src/a.ts:src/a.ts' WHEN 1 THEN 'R:src/a.ts:src/b.ts' WHEN 2 THEN 'A:src/n.ts:src/n.ts' WHEN 3 THEN 'M:yarn.lock:yarn.lock' WHEN 4 THEN 'M:README.md:README.md' WHEN 5 THEN 'M:.github/ci.yml:.github/ci.yml' WHEN 6 THEN 'M:package.json:package.json' WHEN 7 THEN 'M:logo.png:logo.png' ELSE 'M:src/a.ts:src/a.ts;A:src/c.ts:src/c.ts' END"
_COLUMNS = f"CAST({_K} AS {{text}}) AS sha, CASE WHEN {_K} % 11 = 0 THEN 2 ELSE 1 END AS n_parents, CASE WHEN {_K} % 13 = 0 THEN 'renovate' ELSE 'Ann' END AS author, 'ann@x.org' AS email, {_K} AS ts, {_SUBJECT} AS subject, '' AS body, {_FILES} AS files"
ORDERS_JUDGED = f"commits AS (SELECT {_COLUMNS.format(text='VARCHAR')} FROM orders), c1 AS (SELECT *, list_filter(string_split(files, ';'), lambda x: x <> '') AS fs FROM commits), judged AS (SELECT *, {_rules()} AS reason FROM c1)"


def order_commits(spark, sf_dir):
    """Every order as a commit whose parents, author, subject and files follow from its key."""
    return commits(spark, table(spark, sf_dir, "orders").selectExpr(*_split(_COLUMNS.format(text="STRING"))))


def _split(columns: str) -> list[str]:
    return [f"{x} AS {n}" for x, n in (part.rsplit(" AS ", 1) for part in columns.replace("', '", "\0").split(", ")) for x in [x.replace("\0", "', '")]]


@query("f05_order_commits", f"WITH {ORDERS_JUDGED} SELECT sha, reason FROM judged")
def f05_orders(spark, sf_dir):
    return mining.judge(order_commits(spark, sf_dir)).select("sha", "reason")


@query("a23_order_funnel", f"WITH {ORDERS_JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM judged GROUP BY 1")
def a23_orders(spark, sf_dir):
    return mining.funnel(mining.judge(order_commits(spark, sf_dir)))


@query("e13_order_tasks", f"WITH {ORDERS_JUDGED} SELECT subject AS task, arg_min(sha, (ts, sha)) AS sha FROM judged WHERE reason IS NULL GROUP BY subject")
def e13_orders(spark, sf_dir):
    kept = mining.judge(order_commits(spark, sf_dir)).filter("reason is null").select("task", "committer_time", "sha")
    return mining.first_of_text(kept, "task", ["committer_time", "sha"]).select("task", "sha")


SPLIT = (40, 30, 25)
ORDERS = "o AS (SELECT 'r' || o_custkey % 5 AS repo, o_orderkey AS k, o_orderdate AS t, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderdate, o_orderkey::VARCHAR) AS nth, count(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders)"


@query("e13_splits", f"""WITH {ORDERS}, s AS (SELECT repo, any_value(n) AS n, any_value(n) - any_value(n) // 2 AS late, any_value(n) // 2 AS early FROM o GROUP BY repo)
    SELECT repo AS repo_id, 'eval' AS split, least({SPLIT[0]}, late)::BIGINT AS n, true AS apart FROM s UNION ALL SELECT repo, 'tuning', least({SPLIT[1]}, early)::BIGINT, true FROM s UNION ALL SELECT repo, 'holdout', least({SPLIT[2]}, late - least({SPLIT[0]}, late))::BIGINT, true FROM s WHERE late > {SPLIT[0]}""")
def e13_splits(spark, sf_dir):
    """The orders as commits of five repositories: sizes of the three sets, and whether each lies in its half of the time."""
    o = table(spark, sf_dir, "orders")
    f = F.array(F.struct(F.lit("M").alias("status"), F.lit("src/a.ts").alias("pre_path"), F.lit("src/a.ts").alias("post_path")))
    d = o.select(
        F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("repo_id"), F.col("o_orderkey").cast("string").alias("sha"), F.lit("p").alias("parent_sha"), F.array(F.lit("p")).alias("parents"), F.lit("Ann").alias("author_name"), F.lit("ann@x.org").alias("author_email"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("committer_time"), F.concat(F.lit("Correct the shipping address of order "), "o_orderkey", F.lit(" before sending goods")).alias("subject"), F.lit("").alias("body"), f.alias("files"),
    )
    t = mining.splits(d, *SPLIT, config.EVAL_SEED)
    halves = ranks.group_rank(d.select("repo_id", "committer_time", "sha"), "repo_id", ["committer_time", "sha"])
    halves = halves.select("repo_id", "sha", (F.col("rank") > F.floor(F.col("n") / 2)).alias("late"))
    own = t.join(halves, ["repo_id", "sha"]).groupBy("repo_id", "split").agg(F.count("*").alias("n"), F.bool_and(F.col("late") == (F.col("split") != "tuning")).alias("apart"))
    return own.select("repo_id", "split", "n", "apart")


@query("t21_bots", f"WITH e AS (SELECT c_custkey, c_name AS n, CASE c_custkey % 4 WHEN 0 THEN 'noreply@x.org' WHEN 1 THEN 'a.bot@x.org' ELSE 'a@x.org' END AS m FROM customer) SELECT c_custkey, contains(lower(n || ' ' || m), 'noreply') OR contains(lower(n || ' ' || m), 'bot@') AS is_bot FROM e")
def t21(spark, sf_dir):
    m = F.when(F.col("c_custkey") % 4 == 0, "noreply@x.org").when(F.col("c_custkey") % 4 == 1, "a.bot@x.org").otherwise("a@x.org")
    return table(spark, sf_dir, "customer").select("c_custkey", mining.is_bot(F.col("c_name"), m).alias("is_bot"))


TREE = Inline("tree", "parent_sha string, path string, mode string", [("p1", "src/a.ts", "100644"), ("p1", "bin/run", "100755"), ("p1", "link", "120000"), ("p1", "sub", "160000"), ("p2", "link", "120000")])
TASKS_IN = Inline("mtasks", "task_id string, parent_sha string, path string", [("t1", "p1", "src/a.ts"), ("t1", "p1", "link"), ("t1", "p1", "gone.txt"), ("t2", "p2", "link"), ("t3", "p1", "bin/run"), ("t3", "p1", "sub")])


def _fates(spark):
    return mining.mode_gold(TASKS_IN.df(spark).groupBy("task_id", "parent_sha").agg(F.collect_list("path").alias("gold")), TREE.df(spark))


FATES = f"WITH {TREE.sql()}, {TASKS_IN.sql()}, fates AS (SELECT task_id, t.path, CASE WHEN mode IN ('100644', '100755') THEN 'kept' WHEN mode = '120000' THEN 'symlink' WHEN mode = '160000' THEN 'gitlink' ELSE 'missing' END AS fate FROM mtasks t LEFT JOIN tree USING (parent_sha, path))"


@query("j26_gold_modes", f"{FATES} SELECT * FROM fates")
def j26(spark, sf_dir):
    return _fates(spark)


@query("s24_mode_stats", f"{FATES}, p AS (SELECT task_id, count(*) FILTER (fate = 'kept') AS k, count(*) FILTER (fate = 'symlink') AS s, count(*) FILTER (fate = 'gitlink') AS g, count(*) FILTER (fate = 'missing') AS m FROM fates GROUP BY ALL) SELECT count(*) FILTER (k > 0)::BIGINT AS evaluated_tasks, count(*) FILTER (k = 0)::BIGINT AS tasks_dropped_empty_gold, count(*) FILTER (k > 0 AND s + g + m > 0)::BIGINT AS tasks_with_partial_drop, sum(s)::BIGINT AS dropped_symlink, sum(g)::BIGINT AS dropped_gitlink, sum(m)::BIGINT AS dropped_missing FROM p")
def s24(spark, sf_dir):
    return mining.mode_stats(_fates(spark))


LOG = Inline("log", "ord int, line string", [(1, "300"), (2, "a.ts"), (3, "b.ts"), (4, ""), (5, "200"), (6, "b.ts"), (7, "c.ts"), (8, "100"), (9, "d.ts"), (10, "a.ts")])


@query("s19_recency", f"WITH {LOG.sql()}, t AS (SELECT ord, line, last_value(CASE WHEN regexp_full_match(line, '[0-9]+') THEN line::BIGINT END IGNORE NULLS) OVER (ORDER BY ord) AS ts FROM log), m AS (SELECT line AS path, max(ts) AS last_touch FROM t WHERE NOT regexp_full_match(line, '[0-9]*') GROUP BY line) SELECT path, last_touch, (row_number() OVER (ORDER BY last_touch DESC, path) - 1)::INTEGER AS rank FROM m")
def s19(spark, sf_dir):
    return history.recency(LOG.df(spark)).select("path", "last_touch", "rank")


STATUS = "M  src/a.ts|?? new.ts| D gone.ts|R  now.ts|was.ts| M src/b.ts"


@query("s20_status", "SELECT * FROM (VALUES ('src/a.ts', 'staged', NULL), ('new.ts', 'untracked', NULL), ('gone.ts', 'deleted', NULL), ('now.ts', 'staged', 'was.ts'), ('src/b.ts', 'unstaged', NULL)) t(path, state, old_path)")
def s20(spark, sf_dir):
    d = spark.createDataFrame([(STATUS.replace("|", "\x00"),)], "text string")
    return d.select(F.inline(history.parse_status(F.col("text"))))


U, G, R = history.UNIT, history.STACK, history.RECORD
META = f"s1{U}p1 p2{U}Ann{U}a@x{U}50{G}Fix it{U}more\nlines{R}\ns2{U}p3{U}Bob{U}b@x{U}40{G}Other{U}{R}"


@query("s23_history", "SELECT * FROM (VALUES ('s2', 1, 40::BIGINT, 'Other', 1), ('s1', 2, 50::BIGINT, 'Fix it', 2)) t(sha, n_parents, committer_time, subject, n_files)")
def s23(spark, sf_dir):
    meta = spark.createDataFrame([(META,)], "text string").select(F.inline(history.parse_commits(F.col("text"))))
    names = spark.createDataFrame([("s1", "M\ta.ts\nR087\told.ts\tnew.ts"), ("s2", "A\tz.ts")], "sha string, text string").select("sha", history.parse_name_status(F.col("text")).alias("files"))
    return history.mine(meta, names).select("sha", F.size("parents").alias("n_parents"), "committer_time", "subject", F.size("files").alias("n_files"))


CHECKPOINT = Inline("cp", "n int, line string", [(1, '{"task": "a", "ok": true}'), (2, '{"task": "b", "ok": true}'), (3, '{"task": "a", "ok": true}'), (4, '{"task": "x", "ok": true}'), (5, '{"task": "c", "o')])


@query("s27_checkpoint", "SELECT * FROM (VALUES (1, 'a', 'valid'), (2, 'b', 'valid'), (3, 'a', 'duplicate'), (4, 'x', 'foreign'), (5, NULL, 'torn')) t(n, task, state)")
def s27(spark, sf_dir):
    from lodestone.sources.checkpoints import checkpoint_records

    return checkpoint_records(CHECKPOINT.df(spark), ["a", "b", "c"]).select("n", "task", "state")


FAILURES = ["Operation timed out", "ENOENT: gone", "EACCES here", "file is locked", "Unexpected token }", "odd"]


@query("t26_failures", "SELECT * FROM (VALUES ('Operation timed out', 'timeout', true), ('ENOENT: gone', 'not-found', false), ('EACCES here', 'permission', true), ('file is locked', 'busy', true), ('Unexpected token }', 'syntax', false), ('odd', 'unknown', false)) t(message, category, transient)")
def t26(spark, sf_dir):
    c = X.safe_failure_category(F.col("message"))
    return spark.createDataFrame([(m,) for m in FAILURES], "message string").select("message", c.alias("category"), X.is_transient_failure(c).alias("transient"))
