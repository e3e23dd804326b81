"""Secrets: finding them, deciding what happens to their files, blanking and redacting, and the last gate.

Kinds and policies follow the published contract; thresholds that were not published (least length and
entropy, what counts as a placeholder) are our own and marked so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import sensitive_reason
from lodestone.functions.text import is_placeholder, redaction_placeholder, shannon_entropy

# ---- fixed values: kinds, patterns and confidence ----
KINDS = [
    ("aws-access-key", r"AKIA[0-9A-Z]{16}", "high", "AWS access key ID"),
    ("github-token", r"gh[pousr]_[0-9A-Za-z]{30,}", "high", "GitHub token"),
    ("slack-token", r"xox[baprs]-[0-9A-Za-z-]{10,}", "high", "Slack token"),
    ("stripe-live-key", r"(?:sk|rk)_live_[0-9A-Za-z]{10,}", "high", "Stripe live key"),
    ("google-api-key", r"AIza[0-9A-Za-z_-]{35}", "high", "Google API key"),
    ("openai-style-key", r"sk-[0-9A-Za-z_-]{20,}", "high", "API key"),
    ("private-key-block", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[\s\S]*?-----END (?:[A-Z]+ )?PRIVATE KEY-----|[\s\S]*)", "high", "private key"),
    ("jwt", r"eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}", "high", "JSON Web Token"),
    ("basic-auth-url", r"(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@'\"]+:[^\s:/@'\"]+@[^\s'\"]+", "high", "credentialed URL"),
    ("bearer-token", r"Bearer [0-9A-Za-z._~+/-]{16,}=*", "high", "bearer token"),
]
# ---- end of fixed values ----
#: Our own: names that guard a value, its least length and entropy.
GUARDED = r"[A-Za-z0-9_-]*(?:password|passwd|secret|token|api[_-]?key|credential|auth)[A-Za-z0-9_-]*"
QUOTED = rf"(?i){GUARDED}['\"]?\s*[:=]\s*['\"]([^'\"\n]{{8,}})['\"]"
ENV = r"(?m)^[+\- ]?(?:export )?[A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|CREDENTIAL)[A-Z0-9_]*=([^\s'\"]{8,})"
MIN_ENTROPY, MIN_LENGTH = 3.0, 8
#: A text without any of these has no secret of any kind.
HINT = r"AKIA|gh[pousr]_|xox[baprs]-|_live_|AIza|sk-|PRIVATE KEY|eyJ|://[^\s/@]*:[^\s/@]*@|Bearer |(?i:password|passwd|secret|token|api[_-]?key|credential|auth)[A-Za-z0-9_-]*['\"]?\s*[:=]"
GUESSED = [("generic-credential", QUOTED, "medium", "quoted credential assignment"), ("env-credential", ENV, "medium", "environment credential")]
#: A match of a kind holds one of these strings; a quoted assignment also this beginning of its value.
NEEDED = {
    "aws-access-key": ["AKIA"], "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "slack-token": ["xox"], "stripe-live-key": ["_live_"], "google-api-key": ["AIza"], "openai-style-key": ["sk-"],
    "private-key-block": ["PRIVATE KEY-----"], "jwt": ["eyJ"], "basic-auth-url": ["://"], "bearer-token": ["Bearer "], "generic-credential": ["'", '"'], "env-credential": ["="],
}
ASSIGNED = r"[:=]\s*['\"]"
FINDING = "path string, kind string, line int, start int, end int, match string, description string, confidence string"


def count_kinds(texts: DataFrame) -> DataFrame:
    """texts: path, text. path, kind, n: native, for reports over a whole corpus; offsets are not needed."""
    def told(kind: str, values: Column) -> Column:
        """The kind for each value; a text without what the kind needs is not searched for it."""
        needs = reduce(Column.__or__, [F.contains(F.col("text"), F.lit(x)) for x in NEEDED[kind]])
        needs = needs & F.col("text").rlike(ASSIGNED) if kind == "generic-credential" else needs
        return F.when(needs, F.transform(values, lambda _: F.lit(kind))).otherwise(F.array().cast("array<string>"))

    made = [told(k, F.regexp_extract_all("text", F.lit(p), F.lit(0))) for k, p, _, _ in KINDS]
    for kind, pattern, _, _ in GUESSED:
        made.append(told(kind, F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v: (shannon_entropy(v) >= MIN_ENTROPY) & ~is_placeholder(v))))
    return texts.filter(F.col("text").rlike(HINT)).select("path", F.explode(F.concat(*made)).alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n"))


def _entropy(s: str) -> float:
    from collections import Counter
    from math import log2

    return -sum(c / len(s) * log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _placeholder(v: str) -> bool:
    from lodestone.functions.text import PLACEHOLDERS

    low = v.lower()
    return len(set(low)) <= 1 or low in ("test", "none", "null", "undefined", "password", "secret", "token") or any(p in low for p in PLACEHOLDERS)


_ASSIGNED = re.compile(ASSIGNED)
_COMPILED = [(k, re.compile(p), c, d, 0) for k, p, c, d in KINDS] + [(k, re.compile(p), c, d, 1) for k, p, c, d in GUESSED]


def spans(text: str) -> list[tuple]:
    """(kind, start, end, match, description, confidence) in the order of their places."""
    out = []
    for kind, pattern, confidence, description, group in _COMPILED:
        if not any(x in text for x in NEEDED[kind]) or kind == "generic-credential" and not _ASSIGNED.search(text):
            continue
        for m in pattern.finditer(text):
            if group and (_entropy(m[1]) < MIN_ENTROPY or _placeholder(m[1])):
                continue
            out.append((kind, m.start(group), m.end(group), m[group], description, confidence))
    return sorted(out, key=lambda s: (s[1], -s[2], s[0]))


def find(texts: DataFrame) -> DataFrame:
    """texts: path, text. FINDING rows with offsets; most texts are passed over by one native test."""
    d = texts.select("path", "text").filter(F.col("text").rlike(HINT))

    names, kinds = ["path", "kind", "line", "start", "end", "match", "description", "confidence"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text at a time; of a batch only its Arrow buffers and some findings are held."""
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows = []
        for b in batches:
            for i in range(b.num_rows):
                p, t = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows.extend((p, k, t.count("\n", 0, s) + 1, s, e, m, what, c) for k, s, e, m, what, c in spans(t))
                if len(rows) >= 2_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return d.mapInArrow(run, FINDING)


def scan_diff(diff: str, path: str = "") -> list[tuple]:
    """Findings in a diff: each hunk as its old and as its new version, so nothing spans both. Matches are exact parts
    of the diff. Rows of FINDING."""
    pieces = re.findall(r"[^\r\n]*(?:\r\n|\n|\r|$)", diff)
    at, lines = 0, []
    for p in pieces:
        if p:
            lines.append((at, p))
            at += len(p)
    hunks: list[list[tuple[int, str]]] = [[]]
    for start, raw in lines:
        if raw.startswith("@@"):
            hunks.append([])
        else:
            hunks[-1].append((start, raw))
    seen: dict[tuple[int, int, str], tuple] = {}
    for hunk in hunks:
        for drop in ("+", "-"):  # the old version has no added lines, the new one no removed ones
            text, places = [], []
            for start, raw in hunk:
                if raw[:1] == drop:
                    continue
                marked = raw[:1] in "+- " and raw[:1] != ""
                body = raw[1:] if marked else raw
                places.extend(range(start + marked, start + marked + len(body)))
                text.append(body)
            joined = "".join(text)
            for kind, s, e, _, what, confidence in spans(joined):
                while e > s and joined[e - 1] in "\r\n":
                    e -= 1
                first, last = places[s], places[e - 1] + 1
                if first and diff[first - 1] in "+-" and (first == 1 or diff[first - 2] in "\r\n"):
                    first -= kind == "private-key-block"
                seen.setdefault((first, last, kind), (path, kind, diff.count("\n", 0, first) + 1, first, last, diff[first:last], what, confidence))
    return [seen[k] for k in sorted(seen)]


def blank_spans(text: str, found: list[tuple[int, int]]) -> str:
    """The spans as spaces; same length, line ends kept."""
    out = list(text)
    for a, b in found:
        for k in range(max(0, a), min(b, len(out))):
            if out[k] not in "\r\n":
                out[k] = " "
    return "".join(out)


def merge_spans(found: DataFrame, touch: int = 0, by: list[str] = ("path",)) -> DataFrame:
    """Unites spans (start, end, kind) that overlap, or lie at most ``touch`` apart: by, start, end, kind (of the first)."""
    w = Window.partitionBy(*by).orderBy("start", F.desc("end"), "kind")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = found.filter("end > start").withColumn("_reach", F.max("end").over(before))
    d = d.withColumn("_new", F.when(F.col("start") <= F.col("_reach") + touch, 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind")).drop("_island")


def redact(texts: DataFrame, merged: DataFrame) -> DataFrame:
    """texts: path, text; merged: path, start, end, kind, disjoint. path, text with every span replaced by its
    placeholder; line ends inside a span are kept, so other lines keep their numbers."""
    marks = merged.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        text, match = F.col("text"), F.substr("text", s["start"] + 1, s["end"] - s["start"])
        ends = F.array_join(F.regexp_extract_all(match, F.lit(r"\r?\n"), F.lit(0)), "")
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), redaction_placeholder(s["kind"], match), ends)
        return F.struct(piece.alias("out"), s["end"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    return texts.join(marks, "path", "left").select("path", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))


def verdicts(files: DataFrame, findings: DataFrame, policy: str = "block", redacting: bool = True) -> DataFrame:
    """files: path. path, action (blocked, redacted, warned, none) and reasons (sorted). A sensitive path blocks under every policy."""
    per = findings.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.concat("description", F.lit(" ("), "kind", F.lit(")")))).alias("why"))
    d = files.select("path", sensitive_reason(F.col("path")).alias("sensitive")).join(per, "path", "left")
    own = {"block": "blocked", "warn": "redacted" if redacting else "warned", "allow": "none"}[policy]
    action = F.when(F.col("sensitive").isNotNull(), "blocked").when(F.col("n") > 0, own).otherwise("none")
    told = F.array(F.concat(F.col("n").cast("string"), F.lit(" potential secret(s) redacted"))) if own == "redacted" else F.col("why")
    reasons = F.when(F.col("sensitive").isNotNull(), F.array(F.concat(F.lit("sensitive path: "), "sensitive"))).when(F.col("n") > 0, told)
    if own == "none":
        reasons = F.when(F.col("sensitive").isNotNull(), F.array(F.concat(F.lit("sensitive path: "), "sensitive")))
    return d.select("path", action.alias("action"), F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"))


def gated(findings: DataFrame) -> DataFrame:
    """Findings that may not leave: sure ones of any length, others from eight characters."""
    return findings.filter((F.col("confidence") == "high") | (F.length("match") >= 8))


def leaks(findings: DataFrame, payloads: DataFrame) -> DataFrame:
    """payloads: payload_id, path, text: what a package shows of each file. payload_id, kind, path, line of gated
    findings whose value survives. A finding meets the payloads that hold its file."""
    return gated(findings).join(payloads, "path").filter(F.contains(F.col("text"), F.col("match"))).select("payload_id", "kind", "path", "line")


def leak_gate(findings: list[dict], payload: str) -> None:
    """Raises if the value of any gated finding is in the payload; the message names kinds and places only."""
    bad = [f"{f['kind']} at {f['path']}:{f['line']}" for f in findings if (f["confidence"] == "high" or len(f["match"]) >= 8) and f["match"] in payload]
    if bad:
        raise ValueError("SECURITY_BLOCKED: " + ", ".join(sorted(set(bad))))


def line_guard(findings: DataFrame, emitted: DataFrame) -> DataFrame:
    """emitted: path, line, text of lines that are about to be shown. path, line of those that still hold a gated
    finding's own part of that line, or a part of eight characters or more of it."""
    parts = gated(findings).select("path", F.col("line").alias("first"), F.posexplode(F.split("match", r"\r?\n")).alias("k", "part"))
    parts = parts.select("path", (F.col("first") + F.col("k")).alias("line"), "part", F.col("k").alias("k")).filter(F.trim("part") != "")
    return emitted.join(parts, ["path", "line"]).filter(F.contains(F.col("text"), F.col("part")) & ((F.length("part") >= 8) | (F.col("k") == 0))).select("path", "line").distinct()


def report(findings: DataFrame) -> DataFrame:
    """path, n, kinds: findings of each file, kinds sorted and joined."""
    return findings.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
