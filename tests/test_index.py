"""Scanning, the store, change detection and streams."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph, lexical
from lodestone.plans.context_queries import entry_rows
from lodestone.plans.index import index_run
from lodestone.sources import checkpoints, scan, store
from lodestone.streaming import changes


def test_tree_scan(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.ts").write_text("one\ntwo\n")
    (tmp_path / "a/bin.dat").write_bytes(bytes([0, 1, 2, 0, 255, 0, 1]))
    (tmp_path / "cap.md").write_bytes(b"x" * 64)
    (tmp_path / "over.md").write_bytes(b"x" * 65)
    rows = {r.path: r for r in scan.scan(scan.read_tree(spark, str(tmp_path), 64), 64).collect()}
    assert {p: r.status for p, r in rows.items()} == {"a/b/x.ts": "OK", "a/bin.dat": "SKIPPED_BINARY", "cap.md": "OK", "over.md": "SKIPPED_TOO_LARGE"}
    assert rows["a/b/x.ts"].line_count == 2 and rows["over.md"].text is None and rows["cap.md"].language == "markdown"


def test_ignore_rules(spark):
    paths = ["a/hidden.ts", "b/hidden.ts", "build/x.ts", "build/keep.ts", ".env", "src/x.log", "src/keep.tmp"]
    pats = scan.parse_patterns(["build/", "!build/keep.ts", "*.tmp", "!keep.tmp", "!.env"]) + scan.parse_patterns(["hidden.ts"], "a", first=20) + scan.builtin_patterns()
    got = {r.path for r in scan.excluded(spark.createDataFrame([(p,) for p in paths], "path string"), scan.ignore_patterns(spark, pats)).filter("excluded").collect()}
    assert got == {"a/hidden.ts", "build/x.ts", "build/keep.ts", ".env", "src/x.log"}


def test_store_round_trip(spark, tmp_path):
    s = store.EntryStore(spark, str(tmp_path / "s"))
    assert s.load().count() == 0
    s.upsert(entry_rows(spark, 8))
    s.upsert(entry_rows(spark, 3, "n"), spark.createDataFrame([("f7.ts",)], "path string"))
    got = {r.path: r.content_hash for r in s.load().collect()}
    assert len(got) == 7 and got["f0.ts"] == entry_rows(spark, 1, "n").first().content_hash
    v = store.exact_index_version(s.load()).first()[0]
    assert len(v) == 12 and v != store.exact_index_version(entry_rows(spark, 8)).first()[0]
    s.remove(spark.createDataFrame([("f0.ts",)], "path string"))
    assert s.load().count() == 6
    (tmp_path / "s/CURRENT").write_text("6 gen-x\n")
    (tmp_path / "s/.CURRENT.crc").unlink(missing_ok=True)
    assert s.load().count() == 0  # another schema version


def test_store_writes_touched_shards_only(spark, tmp_path):
    """A change of one entry leaves the other shards' files as they are, and a reader's plan outlives it."""
    s = store.EntryStore(spark, str(tmp_path / "s"))
    s.upsert(entry_rows(spark, 40))
    before, plan = s._current()[1], s.load()
    s.upsert(entry_rows(spark, 1, "n"))
    after = s._current()[1]
    assert set(before) == set(after) and sum(before[k] != after[k] for k in after) == 1
    assert plan.count() == 40 == s.load().count() and plan.filter("path = 'f0.ts'").first().content_hash != s.load().filter("path = 'f0.ts'").first().content_hash
    s.upsert(entry_rows(spark, 1, "m"))
    s.remove(spark.createDataFrame([("f0.ts",)], "path string"))
    gens = {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()}
    assert s.load().count() == 39 and len(gens) == 2 and len(list((tmp_path / "s").glob("*.list"))) == 2


def test_incremental_index_equals_rebuild(spark):
    """A seeded walk of creates, edits, deletes and renames."""
    rng, files = random.Random(20260911), {f"f{k}.ts": f"export function a{k}() {{}}\n" for k in range(6)}
    index = dict(files)
    for step in range(20):
        op = rng.choice("cedr")
        name = rng.choice(sorted(files)) if files else None
        touched = []
        if op == "c" or name is None:
            name = f"n{step}.ts"
            files[name] = f"export const c{step} = 1;\n"
            touched = [name]
        elif op == "e":
            files[name] += f"// edit {step}\n"
            touched = [name]
        elif op == "d":
            del files[name]
            touched = [name]
        else:
            files[f"r{step}.ts"] = files.pop(name)
            touched = [name, f"r{step}.ts"]
        if step % 5 == 4:  # flush what has gathered
            touched = sorted(set(files) | set(index))
        if step % 5 == 4:
            snap = spark.createDataFrame([(p, t) for p, t in files.items()] or [], "path string, text string").withColumn("content_hash", F.sha2("text", 256))
            old = spark.createDataFrame([(p, t) for p, t in index.items()], "path string, text string").select("path", F.sha2("text", 256).alias("content_hash"))
            up, gone = changes.apply_changes(spark.createDataFrame([(p, "change") for p in touched], "path string, kind string"), snap, old)
            for r in gone.collect():
                del index[r.path]
            for r in up.collect():
                index[r.path] = r.text
            assert index == files


def test_postings_do_not_depend_on_the_rest(spark):
    """Postings of a file are the same whether it is indexed alone or with others: increments equal rebuilds."""
    rows = [(f"f{k}.ts", ["login"], [], None, [], "cache login " * (k + 1)) for k in range(4)]
    schema = "path string, symbols array<string>, io array<string>, summary string, identifiers array<string>, text string"
    whole = {(r.term, r.path): r.wtf for r in lexical.postings(spark.createDataFrame(rows, schema)).collect()}
    parts = {}
    for r in rows:
        parts |= {(x.term, x.path): x.wtf for x in lexical.postings(spark.createDataFrame([r], schema)).collect()}
    assert whole == parts


def test_edges_after_a_change_equal_derivation(spark):
    files = {"a.ts": "import { b } from './b';\nexport function a() { b(); }\n", "b.ts": "export function b() {}\n", "c.ts": "import { b } from './b';\nb();\n"}
    df = lambda f: spark.createDataFrame(list(f.items()), "path string, text string")
    _, before = index_run(df(files))
    files["b.ts"] = "export function other() {}\n"
    entries, after = index_run(df(files))
    changed = spark.createDataFrame([("b.ts",), ("a.ts",), ("c.ts",)], "path string")
    fresh = after.filter(graph.file_of_node(F.col("source")).isin("a.ts", "b.ts", "c.ts") | F.col("source").startswith("dir:"))
    symbols = entries.select(F.explode("symbol_rows").alias("s")).select(graph.symbol_node(F.col("s.id")).alias("node"))
    got = graph.replace_file_edges(before, changed, fresh, symbols)
    key = lambda d: sorted((r.source, r.target, r.kind) for r in d.collect())
    assert key(got) == key(after)


def test_stream_is_idempotent(spark, tmp_path):
    e = spark.createDataFrame([(f"2026-01-01 00:00:{k:02d}", f"p{k % 3}", "change" if k % 2 else "delete") for k in range(12)], "ts string, path string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    snap = spark.createDataFrame([("p0", "h"), ("p1", "h")], "path string, content_hash string")
    index = spark.createDataFrame([("p1", "old"), ("p2", "h")], "path string, content_hash string")
    run = lambda: changes.run_index(changes.change_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp"), lambda: snap, lambda: index, lambda up, gone: seen.append((sorted(r.path for r in up.collect()), sorted(r.path for r in gone.collect())))).awaitTermination(60)
    run()
    assert {p for up, _ in seen for p in up} == {"p0", "p1"} and {p for _, gone in seen for p in gone} == {"p2"}
    n = len(seen)
    run()  # nothing new
    assert len(seen) == n


def test_flush_anchored_at_first_event(spark):
    d = spark.createDataFrame([(k * 300, "a", "change") for k in range(6)], "ms int, path string, kind string").select(F.timestamp_millis(F.col("ms") + 1000).alias("ts"), "path", "kind")
    assert sorted(r.flush for r in changes.flushes(d, 600).collect()) == [1, 2]


def test_checkpoint_tail(spark):
    lines = spark.createDataFrame([(1, '{"task": "a"}'), (2, '{"task": "b"'), (3, '{"task": "c"}')], "n int, line string")
    assert [r.state for r in checkpoints.checkpoint_records(lines).orderBy("n").collect()] == ["valid", "corrupt", "valid"]
    torn = spark.createDataFrame([(1, '{"task": "a"}'), (2, '{"ta')], "n int, line string")
    r = checkpoints.checkpoint_records(torn)
    assert [x.line for x in checkpoints.repaired(r).collect()] == ['{"task": "a"}']
    assert tuple(checkpoints.checkpoint_state(r, 1, True).first()) == ("completed", 1)




def test_splits_and_decoys(spark):
    """Disjoint sets that extend each other; decoys are drawn from what is neither gold nor drawn already."""
    from lodestone.operators import stats

    files = [f"d{k % 3}/f{k:02}.ts" for k in range(30)]
    gold = [("t1", files[0], True), ("t1", files[3], True), ("t1", files[1], False), ("t2", files[5], True)]
    d = spark.createDataFrame([(p,) for p in files], "path string")
    g = spark.createDataFrame(gold, "task_id string, path string, revealed boolean")
    ranked = d.join(spark.createDataFrame([(p, k) for k, p in enumerate(sorted(files), 1)], "path string, place long"), "path")
    own = {t: {p for a, p, _ in gold if a == t} for t in ("t1", "t2")}
    for rows in (stats.random_decoys(ranked, g).collect(), stats.same_folder_decoys(d, g).collect()):
        got = {t: [r.path for r in rows if r.task_id == t] for t in own}
        assert len(set(got["t1"])) == 2 == len(got["t1"]) and len(got["t2"]) == 1 and not any(set(v) & own[t] for t, v in got.items())
    beside = stats.same_folder_decoys(d, g).collect()
    assert all(r.path.startswith("d0/" if r.task_id == "t1" else "d2/") for r in beside)
    assert stats.decoy_places([1, 2, 3], 5, 4, 7) == [4, 5]


def test_flushes_by_folding(spark):
    """Events over days, in bursts, against the rule applied one event after the other."""
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(600):
        t += rng.choice([0, 50, 300, 599, 600, 601, 900, 5_000_000])
        rows.append((t, f"f{rng.randrange(5)}", rng.choice(["change", "delete"]), rng.choice("ab")))
    d = spark.createDataFrame(rows, "ms long, path string, kind string, workspace string").withColumn("ts", F.timestamp_millis("ms"))
    want = set()
    for ws in "ab":
        first, n, held = None, 0, {}
        for ms, path, kind, _ in sorted(r for r in rows if r[3] == ws):
            if first is None or ms > first + 600:
                first, n = ms, n + 1
            held[n, path] = max(held.get((n, path), (0, "")), (ms, kind))
        want |= {(ws, k, p, kind) for (k, p), (_, kind) in held.items()}
    assert {(r.workspace, r.flush, r.path, r.kind) for r in changes.flushes(d, 600, ["workspace"]).collect()} == want


def test_words_move_once_and_one_path_counts_once(spark):
    """Entries of one path count as one, and neither counting nor scoring deals words by query."""
    from lodestone.config import RETRIEVAL

    schema = "path string, symbols array<string>, io array<string>, summary string, identifiers array<string>, text string"
    twice = [("a.md", [], [], None, ["x1y"], "cache cache"), ("b.md", [], [], None, [], "cached"), ("a.md", [], [], None, [], "cache dog")]
    e = spark.createDataFrame(twice, schema)
    got = {(r.term, r.path): (r.tf, r.body_length) for r in lexical.body_terms(e.select("path", "text")).collect()}
    assert got == {("cache", "a.md"): (3, 4), ("dog", "a.md"): (1, 4), ("cached", "b.md"): (1, 1)}
    index = lexical.postings(e)
    vocab = lexical.vocabulary(index, lexical.count_row(e))
    q = spark.createDataFrame([(1, "cache dog"), (2, "ca"), (3, "caching"), (4, "zebra")], "query_id int, text string")
    new = {(r.query_id, r.path): (round(r.weight, 9), r.matched) for r in lexical.lexical_scores(index, vocab, q).collect()}
    most, lexical.MAX_ASKED = lexical.MAX_ASKED, 0
    try:  # the joins, as they are used for very many queries
        old = {(r.query_id, r.path): (round(r.weight, 9), r.matched) for r in lexical.lexical_scores(index, vocab, q).collect()}
    finally:
        lexical.MAX_ASKED = most
    assert new == old and len(new) == 4 and RETRIEVAL.lexical_weight == 0.9
    assert "Exchange" not in lexical.postings(e.filter("path = 'b.md'"))._jdf.queryExecution().executedPlan().toString()


def test_a_path_is_one_row_of_the_index(spark):
    """Rows of whole paths hold the same postings and score the same, so hits need no shuffle, however many keys serve a term."""
    rows = [(f"d{k % 3}/fileA{k}.md", ["fooBar", "foo"] * (k % 2), ["x_y"], "sum Up", ["ca2Che"], f"cacheLogin HTTPServer2 W{k}x 1ab a_b$c \u00e9t\u00e9 " * (k % 4 + 1) + " ".join(f"w{k}q{j}" for j in range(250 * (k % 2))), k % 5) for k in range(12)]
    e = spark.createDataFrame(rows, "path string, symbols array<string>, io array<string>, summary string, identifiers array<string>, text string, own int")
    whole = lexical.path_postings(e)
    key = lambda d: {(r.term, r.path): round(r.wtf, 12) for r in d.collect()}
    assert whole.count() == 12 and key(lexical.flat(whole)) == key(lexical.postings(e))
    listed = e.withColumn("identifiers", F.concat("identifiers", F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]{2,}"), F.lit(0))), F.lit(1), F.col("own")))).drop("own")
    assert key(lexical.postings(listed)) == key(lexical.postings(e))
    vocab = lexical.vocabulary(whole, lexical.count_row(e))
    q = spark.createDataFrame([(1, "cache w3"), (2, "w"), (3, "server http2 foobar")], "query_id int, text string")
    asked = lexical.ask(q, vocab)
    assert "Exchange" not in lexical.asked_hits(whole, asked)._jdf.queryExecution().executedPlan().toString()
    scores = lambda index: {(r.query_id, r.path): (round(r.weight, 9), r.matched) for r in lexical.lexical_scores(index, vocab, q).collect()}
    assert scores(whole) == scores(lexical.postings(e)) and scores(whole)


def test_spread_sorts_no_texts(spark):
    from lodestone.sources.shared import spread

    d = spark.range(100, numPartitions=1).withColumn("text", F.lit("x"))
    plan = spread(d)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and sorted(r.id for r in spread(d).collect()) == list(range(100))
