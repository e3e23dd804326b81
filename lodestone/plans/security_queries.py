"""Queries of the secret scan, the policies and the gates, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import security
from lodestone.operators.lexical import document_path
from lodestone.plans.base import DOCS, PATH, doc_texts, query, table
from lodestone.plans.inline import Inline
from lodestone.sources.shared import spread, written

#: What follows a document's text, by its id: one secret of each kind, made of the id's md5 (m). The tables themselves hold quoted assignments only.
PLANTS = [
    "' AKIA' || upper(substr(m, 1, 16))", "' ghp_' || m", "' xoxb-' || substr(m, 1, 12)", "' sk_live_' || substr(m, 1, 16)", "' AIza' || m || 'abc'", "' sk-' || m",
    "chr(10) || '-----BEGIN PRIVATE KEY-----' || chr(10) || m || chr(10) || '-----END PRIVATE KEY-----'", "' eyJ' || substr(m, 1, 8) || '.' || substr(m, 9, 8) || '.' || substr(m, 17, 8)",
    "' https://user:' || substr(m, 1, 8) || '@host.example/x'", "' Bearer ' || m", "chr(10) || 'APP_TOKEN=' || m", "' password = \"' || m || '\"'", "' password = \"changeme_' || m || '\"'", "''",
]
_PLANT = f"CASE coalesce(doc_id, 13) % {len(PLANTS)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(PLANTS))} END"
PLANTED = f"docs AS (SELECT path, text || {_PLANT} AS text FROM (SELECT doc_id, {PATH} AS path, coalesce(text, '') AS text, md5(coalesce(doc_id, 13)::VARCHAR) AS m FROM documents))"


def planted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("doc_id", F.lit(13)).cast("string")).alias("m"))
    return spread(d.select("path", F.expr(f"text || {_PLANT}").alias("text")))


def _values(kind: str, pattern: str, group: int) -> str:
    return f"list_transform(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', {group}), lambda v: struct_pack(kind := '{kind}', v := v, guessed := {'true' if group else 'false'}))"


#: Every kind; RE2 has no back-references, so the entropy is added up in SQL.
_FOUND = rf"""m AS (SELECT path, unnest(list_concat({", ".join(_values(k, p, 0) for k, p, _, _ in security.KINDS)}, {", ".join(_values(k, p, 1) for k, p, _, _ in security.GUESSED)})) AS x FROM docs),
    e AS (SELECT path, x.kind AS kind, x.v AS v, x.guessed AS guessed, list_transform(list_distinct(string_split(x.v, '')), lambda c: len(list_filter(string_split(x.v, ''), lambda y: y = c)) / length(x.v)) AS ps FROM m),
    good AS (SELECT path, kind, v FROM e WHERE NOT guessed OR (-list_sum(list_transform(ps, lambda p: p * log2(p))) >= {security.MIN_ENTROPY} AND NOT regexp_matches(lower(v), 'changeme|change_me|example|placeholder|your_|your-|dummy|sample|redacted|<|\$\{{|\{{\{{|process\.env')))"""
FOUND, FOUND_PLANTED = f"{DOCS}, {_FOUND}", f"{PLANTED}, {_FOUND}"


@query("x01_secret_kinds", f"WITH {FOUND} SELECT path, kind, count(*)::BIGINT AS n FROM good GROUP BY path, kind")
def x01(spark, sf_dir):
    return security.count_kinds(doc_texts(spark, sf_dir))


@query("x01_planted_kinds", f"WITH {FOUND_PLANTED} SELECT path, kind, count(*)::BIGINT AS n FROM good GROUP BY path, kind")
def x01p(spark, sf_dir):
    return security.count_kinds(planted(spark, sf_dir))


@query("x01_planted_findings", f"WITH {FOUND_PLANTED} SELECT DISTINCT path, kind, sha256(v) AS value FROM good")
def x01q(spark, sf_dir):
    return security.find(planted(spark, sf_dir)).select("path", "kind", F.sha2("match", 256).alias("value")).distinct()


@query("x03_planted_redacted", f"WITH {FOUND_PLANTED} SELECT path, (SELECT count(*) FROM good g WHERE g.path = docs.path AND contains(docs.text, g.v))::BIGINT AS held, 0::BIGINT AS left_over FROM docs")
def x03p(spark, sf_dir):
    """How many findings a text held, and how many values are left in it once it is redacted."""
    d = planted(spark, sf_dir)
    f = written(security.find(d), "planted-findings")
    r = security.redact(d, security.merge_spans(f.select("path", "start", "end", "kind"))).withColumnRenamed("text", "safe")
    n = f.join(r, "path").groupBy("path").agg(F.count("*").alias("held"), F.count_if(F.contains(F.col("safe"), F.col("match"))).alias("left_over"))
    return d.select("path").join(n, "path", "left").select("path", F.coalesce("held", F.lit(0)).cast("long").alias("held"), F.coalesce("left_over", F.lit(0)).cast("long").alias("left_over"))


@query("x01_findings", f"WITH {FOUND} SELECT DISTINCT path, kind, sha256(v) AS value FROM good")
def x01b(spark, sf_dir):
    return security.find(doc_texts(spark, sf_dir)).select("path", "kind", F.sha2("match", 256).alias("value")).distinct()


@query("x02_policy", f"WITH {FOUND} SELECT path, CASE WHEN path IN (SELECT path FROM good) THEN 'blocked' ELSE 'none' END AS action FROM docs")
def x02(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    return security.verdicts(d, security.find(d)).select("path", "action")


@query("f04_sensitive_veto", "WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '/.env' WHEN 1 THEN '.key' WHEN 2 THEN '/id_ed25519.pub' ELSE '.md' END AS path FROM part) SELECT p_partkey, path FROM p WHERE NOT (" + " OR ".join(f"regexp_matches(path, '{p}')" for p, _ in config.SENSITIVE_PATHS) + ")")
def f04(spark, sf_dir):
    from lodestone.functions.paths import sensitive_reason

    k = F.col("p_partkey") % 4
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(k == 0, "/.env").when(k == 1, ".key").when(k == 2, "/id_ed25519.pub").otherwise(".md")).alias("path"))
    return d.filter(sensitive_reason(F.col("path")).isNull())


SPANS = "sp AS (SELECT l_orderkey::VARCHAR AS path, l_partkey % 50 AS start, l_partkey % 50 + 1 + l_linenumber AS \"end\", l_returnflag AS kind FROM lineitem)"


def spans_of(spark, sf_dir):
    at = F.col("l_partkey") % 50
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), at.alias("start"), (at + 1 + F.col("l_linenumber")).alias("end"), F.col("l_returnflag").alias("kind"))


def _islands(touch: int) -> str:
    return f"""WITH {SPANS}, o AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY start, "end" DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp), n AS (SELECT *, sum(CASE WHEN start <= reach + {touch} THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY start, "end" DESC, kind ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT path, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", first(kind ORDER BY start, "end" DESC, kind) AS kind FROM n GROUP BY path, island"""


@query("w05_merge_spans", _islands(0))
def w05(spark, sf_dir):
    return security.merge_spans(spans_of(spark, sf_dir))


@query("w06_merge_ranges", _islands(1))
def w06(spark, sf_dir):
    return security.merge_spans(spans_of(spark, sf_dir), touch=1)


@query("x03_redact", rf"""WITH {DOCS} SELECT path, sha256(regexp_replace(text, '(token = )"[0-9a-f]{{40}}"', '\1"[KEY]"', 'g')) AS digest FROM docs""")
def x03(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    return d.select("path", F.sha2(F.regexp_replace("text", '(token = )"[0-9a-f]{40}"', '$1"[KEY]"'), 256).alias("digest"))


@query("x03_redacted_lines", f"WITH {FOUND} SELECT path, (length(text) - length(replace(text, chr(10), '')))::INTEGER AS feeds, (SELECT count(*) FROM good g WHERE g.path = docs.path)::BIGINT AS placeholders FROM docs")
def x03b(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    merged = security.merge_spans(security.find(d).select("path", "start", "end", "kind"))
    r = security.redact(d, merged)
    return r.select("path", (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("feeds"), F.regexp_count("text", F.lit(r"\[REDACTED:[a-z-]+:[0-9a-f]{8}\]")).cast("long").alias("placeholders"))


@query("j23_leaks", f"WITH {FOUND} SELECT DISTINCT g.path AS path, sha256(v) AS value FROM good g JOIN docs d USING (path) WHERE contains(d.text, g.v)")
def j23(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    f = security.find(d)
    hit = security.gated(f).join(d, "path").filter(F.contains(F.col("text"), F.col("match")))
    return hit.select("path", F.sha2("match", 256).alias("value")).distinct()


@query("x04_no_leak_after_redaction", f"WITH {DOCS} SELECT path, 0 AS n FROM docs WHERE false")
def x04(spark, sf_dir):
    d = doc_texts(spark, sf_dir)
    f = security.find(d)
    r = security.redact(d, security.merge_spans(f.select("path", "start", "end", "kind")))
    return security.leaks(f, r.select(F.lit(0).alias("payload_id"), "path", "text")).groupBy("path").agg(F.lit(0).alias("n"))


FINDINGS = Inline("fi", "path string, kind string, line int, match string, confidence string", [("a", "jwt", 3, "short", "high"), ("a", "generic-credential", 4, "tiny", "medium"), ("b", "env-credential", 1, "long enough", "medium"), ("b", "jwt", 2, "one\ntwo two two", "high")])
EMITTED = Inline("em", "path string, line int, text string", [("a", 3, "x short y"), ("a", 4, "x tiny y"), ("b", 1, "nothing"), ("b", 2, "say one"), ("b", 3, "a two two two b"), ("c", 3, "short")])


@query("f08_gated", f"WITH {FINDINGS.sql()} SELECT path, kind, line FROM fi WHERE confidence = 'high' OR length(match) >= 8")
def f08(spark, sf_dir):
    return security.gated(FINDINGS.df(spark)).select("path", "kind", "line")


@query("j22_line_guard", "SELECT * FROM (VALUES ('a', 3), ('b', 2), ('b', 3)) t(path, line)")
def j22(spark, sf_dir):
    return security.line_guard(FINDINGS.df(spark), EMITTED.df(spark))


@query("x05_allow_is_not_off", "SELECT * FROM (VALUES ('a', 'none', 2::BIGINT), ('b', 'none', 2::BIGINT)) t(path, action, gated)")
def x05(spark, sf_dir):
    """Under every policy the findings stay for the gates."""
    f = FINDINGS.df(spark).withColumn("description", F.lit("d"))
    v = security.verdicts(f.select("path").distinct(), f, policy="allow")
    return v.join(f.groupBy("path").agg(F.count("*").alias("gated")), "path").select("path", "action", "gated")


@query("a29_finding_report", f"WITH {FOUND} SELECT path, count(*)::BIGINT AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM good GROUP BY path")
def a29(spark, sf_dir):
    return security.report(security.find(doc_texts(spark, sf_dir)))
