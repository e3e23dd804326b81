"""Plain rankers to compare with: Okapi BM25 over contents, words of file names, and a seeded shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import base_name, path_tokens
from lodestone.functions.text import tokenize
from lodestone.operators.lexical import CELLS, MAX_ASKED, Best, rounded, spans
from lodestone.operators.ranks import global_rank
from lodestone.sources.shared import written

K1, B = 1.2, 0.75
MAX_CHARS, MAX_TOKENS = 500_000, 50_000


def task_tokens(tasks: DataFrame) -> DataFrame:
    return tasks.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def bm25(docs: DataFrame, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """docs: path, text; tasks: query_id, text. query_id, path, score (over 0, six decimals); limit: the best of each task only, ties by path.

    Documents are counted where they lie, each as one row of the terms that any task asks for; their scores are summed in place, so neither
    words nor pairs of task and path are brought together. Beyond MAX_ASKED terms the plain joins are used."""
    asked = written(task_tokens(tasks), "okapi-asked")
    ids = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(dict(tasks.dtypes)["query_id"])
    if ids is None or asked.count() > MAX_ASKED:
        out = _joined_bm25(docs, tasks)
        return out if limit is None else ranked(out, limit).drop("rank")
    return _bm25_in_place(docs, asked, dict(tasks.dtypes)["query_id"], ids, limit)


def _bm25_in_place(docs: DataFrame, asked: DataFrame, kind: str, id_type: pa.DataType, limit: int | None) -> DataFrame:
    pairs = [tuple(r) for r in asked.collect()]
    words = {t: k for k, t in enumerate(sorted({t for _, t in pairs}))}
    number = {q: k for k, q in enumerate(dict.fromkeys(q for q, _ in pairs))}
    ids, n_words, n_queries = pa.array(list(number), id_type), len(words), len(number)
    by_word = sorted((words[t], number[q]) for q, t in pairs)
    starts = np.concatenate([[0], np.cumsum(np.bincount(np.array([w for w, _ in by_word], np.int64), minlength=n_words))]).astype(np.int64)
    queries = np.array([q for _, q in by_word], np.int64)
    tokens = F.slice(tokenize(F.substring(F.coalesce("text", F.lit("")), 1, MAX_CHARS)), 1, MAX_TOKENS)
    plain = docs.select("path", tokens.alias("tokens"), F.array_distinct(path_tokens(F.col("path"))).alias("own"))

    def count(batches):
        """A row for each document: its length, the numbers of the asked words that it holds, how often, and those of its path."""
        for b in batches:
            n = pa.compute.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            held = []
            for c in ("tokens", "own"):
                size = pa.compute.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                word = pa.compute.index_in(b.column(c).flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
                there = ~np.isnan(word)
                cell, tf = np.unique(np.repeat(np.arange(len(n)), size)[there] * n_words + word[there].astype(np.int64), return_counts=True)
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cell // max(1, n_words), minlength=len(n)))]), pa.int32())
                held += [pa.ListArray.from_arrays(at, pa.array(cell % max(1, n_words), pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(n, pa.int32()), *held[:3]], ["path", "len", "word", "tf", "own"])

    vocabulary = pa.array(list(words), pa.string())
    counts = written(plain.mapInArrow(count, "path string, len int, word array<int>, tf array<int>, own array<int>"), "okapi-counts")
    total = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.count_distinct("path").alias("paths")).first()
    twice = written(counts.groupBy("path").count().filter("count > 1").select("path"), "okapi-twice") if total["paths"] < total["n"] else None
    one = counts
    if twice is not None:  # rows of one path and length count as one
        same = counts.join(F.broadcast(twice) if twice.count() <= 100_000 else twice, "path", "left_semi")
        summed = same.select("path", "len", F.explode(F.arrays_zip("word", "tf")).alias("x")).groupBy("path", "len", F.col("x.word").alias("word")).agg(F.sum("x.tf").cast("int").alias("tf"))
        summed = summed.groupBy("path", "len").agg(F.collect_list(F.struct("word", "tf")).alias("x")).select("path", "len", F.col("x.word").alias("word"), F.col("x.tf").alias("tf"))
        one = counts.join(twice, "path", "left_anti").unionByName(summed.join(same.groupBy("path").agg(F.first("own").alias("own"), F.count("*").alias("copies")), "path").select("path", "len", "word", "tf", F.flatten(F.array_repeat("own", F.col("copies").cast("int"))).alias("own")))
        one = written(one, "okapi-once")
    idf = np.zeros(n_words)
    for r in one.select(F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect():  # a row for each asked word
        idf[r["word"]] = math.log(1 + (total["n"] - r["df"] + 0.5) / (r["df"] + 0.5))
    avg_len, step = total["avg_len"], max(1, CELLS // max(1, n_queries))

    def cells(b):
        """The scores of a few documents for all tasks that share a word with them: task, place, score."""
        size = pa.compute.list_value_length(b.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
        word = b.column("word").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = b.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        length = np.repeat(b.column("len").to_numpy(zero_copy_only=False).astype(np.float64), size)
        part = idf[word] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / avg_len)) if len(word) else np.zeros(0)
        row, k = spans(starts, word)
        at = np.repeat(np.arange(len(size)), size)[row] * n_queries + queries[k]
        score, there = np.bincount(at, part[row], len(size) * n_queries), np.bincount(at, minlength=len(size) * n_queries)
        own = b.column("own").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own_size = pa.compute.list_value_length(b.column("own")).to_numpy(zero_copy_only=False).astype(np.int64)
        row, k = spans(starts, own)
        hits = np.bincount(np.repeat(np.arange(len(size)), own_size)[row] * n_queries + queries[k], minlength=len(size) * n_queries)
        cell = np.flatnonzero(there)
        cell = cell[score[cell] > 0]
        return cell % n_queries, cell // n_queries, score[cell], hits[cell]

    def parts(batches):
        for batch in batches:
            for first in range(0, batch.num_rows if n_queries else 0, step):
                b = batch.slice(first, step)
                yield b.column("path"), *cells(b)

    def every(batches):
        for path, q, p, s, h in parts(batches):
            for k in range(0, len(q), 100_000):
                c = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[c])), path.take(pa.array(p[c])), pa.array(rounded(s[c] + 0.001 * h[c]))], columns)

    def best(batches):
        kept = Best(limit, n_queries)
        for path, q, p, s, h in parts(batches):
            near = np.flatnonzero(s + 0.001 * h >= kept.least[q] - 1e-5)
            kept.add(q[near], path, p[near], rounded(s[near] + 0.001 * h[near]))
            yield from kept.full(ids, columns)
        yield from kept.out(ids, columns)

    def apart(batches):
        for path, q, p, s, h in parts(batches):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), path.take(pa.array(p)), pa.array(s), pa.array(h, pa.int64())], [*columns, "hits"])

    columns, schema = ["query_id", "path", "score"], f"query_id {kind}, path string, score double"
    run = every if limit is None else best
    if twice is None:
        out = one.mapInArrow(run, schema)
    else:  # a path with several lengths has several rows, which add up
        lone, several = one.join(twice, "path", "left_anti"), one.join(twice, "path", "left_semi").mapInArrow(apart, f"{schema}, hits long")
        several = several.groupBy("query_id", "path").agg(F.round(F.sum("score") + 0.001 * F.max("hits"), 6).alias("score"))
        out = lone.mapInArrow(run, schema).unionByName(several)
    return out if limit is None else ranked(out, limit).drop("rank")


def _joined_bm25(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The same by joins. Terms that no task asks for only count towards the lengths; they never leave their partition."""
    tokens = F.slice(tokenize(F.substring(F.coalesce("text", F.lit("")), 1, MAX_CHARS)), 1, MAX_TOKENS)
    d = docs.select("path", tokens.alias("tokens"), F.array_distinct(path_tokens(F.col("path"))).alias("own"))
    stats = d.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    asked = task_tokens(tasks)
    wanted = asked.select("term").distinct()
    tf = d.select("path", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("path", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", "avg_len", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = asked.join(idf, "term").join(tf, "term").groupBy("query_id", "path").agg(F.sum(part).alias("score"))
    own = d.select("path", F.explode("own").alias("term")).join(asked, "term").groupBy("query_id", "path").agg(F.count("*").alias("hits"))
    out = scores.filter("score > 0").join(own, ["query_id", "path"], "left")
    return out.select("query_id", "path", F.round(F.col("score") + 0.001 * F.coalesce("hits", F.lit(0)), 6).alias("score"))


def filename(paths: DataFrame, tasks: DataFrame) -> DataFrame:
    """query_id, path, score: words of the name count twice, of the folders once, times their rarity. Tasks of the same words are
    scored once, so what is summed does not grow with how many tasks ask alike; only the result has a row for each of them."""
    tok = paths.select("path", F.array_distinct(path_tokens(F.col("path"))).alias("full"), F.array_distinct(path_tokens(base_name(F.col("path")))).alias("base"))
    words = tok.select("path", F.explode(F.array_union("full", "base")).alias("term"), "base").select("path", "term", F.when(F.array_contains("base", F.col("term")), 2).otherwise(1).alias("w"))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    n = paths.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    idf = df.join(F.broadcast(n)).select("term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    asked = tasks.groupBy("query_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(tokenize(F.col("text")))))).alias("terms"))
    asked = written(asked.select("query_id", "terms", F.array_join("terms", " ").alias("asks")), "filename-asked")
    sets = asked.groupBy("asks").agg(F.first("terms").alias("terms")).select("asks", F.explode("terms").alias("term"))
    hits = sets.join(idf, "term").join(words, "term")
    scores = hits.groupBy("asks", "path").agg(F.round(F.sum(F.col("w") * F.col("idf")), 6).alias("score"))
    return scores.join(asked.select("query_id", "asks"), "asks").select("query_id", "path", "score")


def random_windows(paths: DataFrame, tasks: DataFrame, seed: int, limit: int) -> DataFrame:
    """query_id, path, rank: ``limit`` paths of each task, from a place that its text and the seed draw
    in one common random order. No product of tasks and paths is made."""
    placed = global_rank(paths.withColumn("_h", F.xxhash64(F.lit(seed), "path").cast("double")), "_h", ["path"]).select("path", F.col("rank").alias("place"))
    n = paths.agg(F.count("*").alias("n"))
    starts = tasks.join(F.broadcast(n)).filter("n > 0").select("query_id", "n", F.pmod(F.xxhash64(F.lit(seed), "text"), F.col("n")).alias("start"))
    wanted = starts.select("query_id", "n", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(limit), F.col("n")) - 1)).alias("k"))
    wanted = wanted.select("query_id", ((F.col("start") + F.col("k")) % F.col("n") + 1).alias("place"), (F.col("k") + 1).cast("int").alias("rank"))
    return wanted.join(placed, "place").select("query_id", "path", "rank")


def ranked(scores: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """Adds rank by falling score, ties by path; Spark keeps ``limit`` of each group before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
