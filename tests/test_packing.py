"""Budgets, rendering, security and what is read back."""

import pytest
from pyspark.sql import functions as F

from lodestone.config import Budget
from lodestone.operators import packing, security
from lodestone.plans import context
from lodestone.plans.retrieve import Corpus

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
TOKEN = "d4f1" + "a09c" + "77bd" + "e2f3" + "a1b2" + "c3d4e5f6a7b8"


def test_kinds():
    text = "\n".join([f"id = '{KEY}'", "gh" + "p_" + "0123456789abcdefghijklmnopqrstuvwxyzAB", "xox" + "b-123456789012-abcdef", "sk_" + "live_a1b2c3d4e5f6g7h8", "sk-" + "proj-a1b2c3d4e5f6g7h8i9j0", f'const apiKey = "{TOKEN}"', f"AUTH_TOKEN={TOKEN}", "https" + "://u:secret1@h.org/x"])
    assert {k for k, *_ in security.spans(text)} >= {"aws-access-key", "github-token", "slack-token", "stripe-live-key", "openai-style-key", "generic-credential", "env-credential", "basic-auth-url"}
    assert security.spans("const a = process.env.API_KEY; password = 'xxx'; secret = 'test'") == []


def test_key_blocks_and_diffs():
    begin, end = "-----BEGIN RSA " + "PRIVATE KEY-----", "-----END RSA " + "PRIVATE KEY-----"
    diff = "\n".join(["@@ -1,2 +1,5 @@", " context", "+" + begin, "+" + TOKEN, "+" + end, "+export const after = 1;"])
    key = next(f for f in security.scan_diff(diff, "src/leak.ts") if f[1] == "private-key-block")
    assert begin in key[5] and end in key[5] and TOKEN in key[5] and "after" not in key[5] and key[2] == 3 and key[5] in diff
    split = "\n".join(["@@ -1,3 +1,3 @@", "+" + begin, "-unrelated", "-" + end])
    keys = [f for f in security.scan_diff(split) if f[1] == "private-key-block"]
    assert [k[5] for k in keys] == ["+" + begin]
    assert security.scan_diff("+export const ok = 1;\n-export const stale = 2;\n ctx") == []


def test_blanking_keeps_lines():
    t = "line1\nline2\nline3"
    b = security.blank_spans(t, [(3, 14)])
    assert len(b) == len(t) and b.count("\n") == 2 and b.startswith("lin")


@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_overlapping_spans_are_one(spark, feed):
    text = feed.join(["a", "SECRET1", "SECRET2", "tail"])
    s, e = text.index("SECRET1"), text.index("tail") - len(feed)
    d = spark.createDataFrame([("p", text)], "path string, text string")
    found = spark.createDataFrame([("p", s, s + 9, "k1"), ("p", s + 5, e, "k2"), ("p", s + 1, s + 3, "k3")], "path string, start int, end int, kind string")
    merged = security.merge_spans(found)
    assert [tuple(r) for r in merged.collect()] == [("p", s, e, "k1")]
    out = security.redact(d, merged).first().text
    assert "SECRET" not in out and out.startswith("a" + feed + "[REDACTED:k1:") and out.endswith("tail") and out.count("\n") == text.count("\n")


def test_policies(spark):
    files = spark.createDataFrame([("a.ts",), ("b.ts",), ("x/.env",)], "path string")
    f = spark.createDataFrame([("a.ts", "jwt", 1, 0, 9, "m", "token", "high")], security.FINDING)
    of = lambda **k: {r.path: r.action for r in security.verdicts(files, f, **k).collect()}
    assert of(policy="block") == {"a.ts": "blocked", "b.ts": "none", "x/.env": "blocked"}
    assert of(policy="warn")["a.ts"] == "redacted" and of(policy="warn", redacting=False)["a.ts"] == "warned" and of(policy="allow") == {"a.ts": "none", "b.ts": "none", "x/.env": "blocked"}


def test_gate():
    with pytest.raises(ValueError, match="SECURITY_BLOCKED: jwt at a:3"):
        security.leak_gate([{"kind": "jwt", "path": "a", "line": 3, "match": "abc", "confidence": "high"}], "x abc y")
    security.leak_gate([{"kind": "g", "path": "a", "line": 3, "match": "abc", "confidence": "medium"}], "x abc y")


def test_ledger_skips_what_does_not_fit():
    import pandas as pd

    rows = pd.DataFrame({"path": ["a", "b", "c"], "text": ["x" * 10, "y" * 5000, "z" * 10], "symbols": [[], [], []]})
    got = packing.fill(rows, Budget(max_chars=1000))
    assert [r["level"] for r in got] == ["FULL", "METADATA", "FULL"] and "budget" in got[1]["note"]


def test_symbol_ladder():
    text = "\n".join(f"line {k}" for k in range(1, 101))
    symbols = [{"id": "a", "kind": "class", "start_line": 2, "end_line": 9, "signature": "class A"}, {"id": "b", "kind": "method", "start_line": 10, "end_line": 12, "signature": "b()"}]
    import pandas as pd

    got = packing.fill(pd.DataFrame({"path": ["a"], "text": [text], "symbols": [symbols]}), Budget(max_lines_per_file=10))
    assert got[0]["level"] == "SYMBOLS" and "### LINES: 2-11" in got[0]["section"] and "12: line 12" not in got[0]["section"]


def test_fence_cannot_be_closed_from_inside():
    s = packing.section("a", [(1, 1, "1: ````")])
    assert "`````\n1: ````\n`````" in s


def test_budget_refuses():
    with pytest.raises(ValueError):
        Budget(max_lines=9)


@pytest.mark.parametrize("policy", ["block", "warn"])
def test_packages(spark, policy):
    e = spark.createDataFrame([(f"src/a{k}.ts", ["login"], [], None, [], f"export function login{k}() {{}}\n" + (f"const k = '{KEY}';\n" if k == 1 else "")) for k in range(4)], "path string, symbols array<string>, io array<string>, summary string, identifiers array<string>, text string")
    q = spark.createDataFrame([(7, "login"), (8, "nothing matches zzzz")], "query_id int, text string")
    budget = Budget(max_chars=20_000, max_files=3)
    rows = {r.query_id: r for r in context.packages(spark, Corpus(e), q, e.select("path", "text"), budget=budget, policy=policy).collect()}
    p = rows[7]
    assert KEY not in p.payload and len(p.payload) <= budget.max_chars and len(p.files) == 3
    assert ("excluded by security policy" in p.payload) == (policy == "block") and f"FILES_INCLUDED: {len(p.files)}" in p.payload
    assert rows[8].files == [] and "(no files)" in rows[8].payload
    d = spark.createDataFrame([(1, p.payload)], "payload_id int, text string")
    assert [r.path for r in packing.package_files(d).orderBy("ord").collect()] == p.files
    why = {r.path: r.included for r in packing.package_why(d).collect()}
    assert {k for k, v in why.items() if v} == set(p.files)
    again = {r.query_id: r.payload for r in context.packages(spark, Corpus(e), q, e.select("path", "text").repartition(5), budget=budget, policy=policy).collect()}
    assert again[7] == p.payload


def test_allow_still_gated(spark):
    e = spark.createDataFrame([("src/a.ts", ["login"], [], None, [], f"const k = '{KEY}';\n")], "path string, symbols array<string>, io array<string>, summary string, identifiers array<string>, text string")
    q = spark.createDataFrame([(7, "login")], "query_id int, text string")
    with pytest.raises(Exception, match="SECURITY_BLOCKED"):
        context.packages(spark, Corpus(e), q, e.select("path", "text"), policy="allow").collect()


def test_line_numbers_of_findings(spark):
    d = spark.createDataFrame([("a", f"one\ntwo {KEY}\n"), ("b", None), ("c", "")], "path string, text string")
    assert [(r.path, r.line, r.kind) for r in security.find(d).collect()] == [("a", 2, "aws-access-key")]
    assert security.count_kinds(d.filter("text is not null")).select("path", "n").collect()[0] == ("a", 1)
    assert d.select(F.count("*")).first()[0] == 3
