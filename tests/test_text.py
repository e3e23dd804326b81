"""Scalar functions against pinned cases and plain Python."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as X
from lodestone.operators import lexical, stats


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_identifier_words(spark):
    assert one(spark, "parseHTMLString rate_limit v2API é9", X.tokenize_identifier) == ["parse", "html", "string", "rate", "limit", "v2", "api", "9"]


def test_identifier_words_like_python(spark):
    texts = ["aB1C", "ABCd", "A1b2", "x__Y", "ümlautÄ", "HTTPServer2", "", "a-b.c/d"]
    d = spark.createDataFrame([(t,) for t in texts], "v string").select("v", X.tokenize_identifier(F.col("v")).alias("r"))
    for row in d.collect():
        assert row.r == [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+", row.v)]


def test_query_analysis(spark):
    d = spark.createDataFrame([('Add rate limiting to the "login endpoint" in authRoutes.ts?',)], "v string")
    a = X.analyze_query(F.col("v"))
    r = d.select(*[c.alias(k) for k, c in a.items()]).first()
    assert r.file_hints == ["authroutes.ts"] and r.quoted_phrases == ["login endpoint"]
    assert {"rate", "limiting", "login"} <= set(r.terms) and not {"add", "the"} & set(r.terms)


def test_body_terms(spark):
    texts = [("a", "// Cache invalidation for the retry queue\ncacheInvalidation(); /* the the the */"), ("b", "cache " * 30 + "zzz")]
    rows = lexical.body_terms(spark.createDataFrame(texts, "path string, text string")).collect()
    got = {(r.path, r.term): (r.tf, r.body_length) for r in rows}
    assert got == {("a", "cache"): (2, 6), ("a", "invalidation"): (2, 6), ("a", "retry"): (1, 6), ("a", "queue"): (1, 6), ("b", "cache"): (8, 31), ("b", "zzz"): (1, 31)}


def test_entropy_and_placeholders(spark):
    assert one(spark, "aaaaaaaaaaaaaaaa", X.shannon_entropy) == 0
    assert one(spark, "J8s2kLq9zX1pQw7vR3mN", X.shannon_entropy) > 3.5
    for v, is_one in (("changeme", True), ("${DATABASE_PASSWORD}", True), ("xxxxxxxx", True), ("J8s2kLq9zX1pQw7vR3mN", False)):
        assert one(spark, v, X.is_placeholder) is is_one


def test_paths(spark):
    for p, want in ((r"C:\a\.\b\..\c.TS", "a/c.TS"), ("../../x", "x"), ("/a//b/", "a/b"), ("", "")):
        assert one(spark, p, P.to_posix) == want
    assert one(spark, ".env", P.ext_name) == "" and one(spark, "a/b.Test.JS", P.ext_name) == ".js"
    assert one(spark, "..notes.ts", P.has_traversal) is False and one(spark, "a/../b", P.has_traversal) is True


def test_tokens_half_up(spark):
    d = spark.createDataFrame([(0,), (14,), (15,), (25,)], "n int").select(X.estimate_tokens_approx(F.col("n")).alias("r"))
    assert [r.r for r in d.collect()] == [10, 10, 20, 30]


def test_hash_of_text(spark):
    for v in ("", "a", "hello world"):
        assert one(spark, v, X.fnv1a) == stats.fnv1a(v)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_counter_based_numbers(seed):
    """The vector form equals the step-by-step generator."""
    a, out = seed, []
    for _ in range(5):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t = (t ^ (t + (((t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF))) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 4294967296)
    assert stats.uniform(seed, 0, 5).tolist() == out and stats.uniform(seed, 3, 2).tolist() == out[3:]


def test_bootstrap():
    import numpy as np

    mean, low, high = stats.bootstrap(np.ones(4), 1)
    assert (mean, low, high) == (1, 1, 1) and stats.bootstrap(np.array([]), 1) == (0, 0, 0)
    _, low, high = stats.bootstrap(np.arange(50.0), 7)
    assert low < 24.5 < high and math.isclose(high - low, 2 * 1.96 * 14.4 / math.sqrt(50), rel_tol=0.3)


def test_null_texts(spark):
    d = spark.createDataFrame([(None,), ("",)], "v string")
    v = F.col("v")
    r = d.select(X.tokenize_identifier(v).alias("t"), X.canonical_term(v).alias("c"), X.fence_length(F.coalesce(v, F.lit(""))).alias("f"), P.to_posix(v).alias("p"), X.shannon_entropy(v).alias("e")).collect()
    assert r[1].t == [] and r[1].c == "" and r[1].p == "" and r[0].f == 3 and r[1].e == 0


def test_lines_of_a_message_keep_their_first_digits(spark):
    d = spark.createDataFrame([("Fix", "0 a\n 1219 b\r\n2 c ")], "subject string, body string")
    assert d.select(X.clean_task_text(F.col("subject"), F.col("body"))).first()[0] == "Fix 0 a 1219 b 2 c"


def test_identifiers_without_a_limit(spark):
    text = " ".join(f"name{k}" for k in range(900))
    assert len(one(spark, text, lambda c: X.extract_identifiers(c))) == 400
    assert len(one(spark, text, lambda c: X.extract_identifiers(c, None))) == 900
