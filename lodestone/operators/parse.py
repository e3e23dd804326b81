"""Parsers: from the text of a file to symbols, imports, exports, calls and parents.

Markdown is parsed by windows over lines. JSON and scripts need a state machine and run in Python, Arrow
batches at a time. Scripts have no compiler here: a lexer blanks comments and strings, and braces give the
nesting; what it takes is imports, exports, functions, classes with members, interfaces, types, enums, arrow constants and calls.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import parser_of

MAX_HEADINGS, MAX_KEYS, MAX_DEPTH, MAX_ITEMS, TOP_KEYS = 150, 200, 4, 20, 12
SYMBOL = "array<struct<id:string,name:string,kind:string,start_line:int,end_line:int,signature:string,export_kind:string,parent_id:string>>"
PARSED = (
    f"path string, parser string, symbols {SYMBOL}, imports array<struct<specifier:string,names:array<string>,locals:array<string>,line:int>>, exports array<string>, "
    "calls array<struct<caller_id:string,callee:string,line:int>>, heritages array<struct<symbol_id:string,kind:string,parent:string,line:int>>, summary string, error string"
)
NAMES = ["path", "parser", "symbols", "imports", "exports", "calls", "heritages", "summary", "error"]


# ---- Markdown, by windows ----


def markdown_lines(texts: DataFrame) -> DataFrame:
    """texts: path, text. path, line (from 1), content of the lines outside fences, and fence_lang of lines that open one."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)
    lang = F.regexp_extract("content", r"^\s*```\s*([A-Za-z0-9_+-]*)\s*$", 1)
    fence = F.col("content").rlike(r"^\s*```\s*[A-Za-z0-9_+-]*\s*$")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumns({"fence": fence, "n_fences": F.count_if(fence).over(w)})
    d = d.withColumn("fence_lang", F.when(F.col("fence") & (F.col("n_fences") % 2 == 1) & (lang != ""), lang))
    return d.filter(F.col("fence_lang").isNotNull() | (~F.col("fence") & (F.col("n_fences") % 2 == 0))).select("path", "line", "content", "fence_lang")


def headings(lines: DataFrame) -> DataFrame:
    """path, line, level, title, ord, parent_line: the first MAX_HEADINGS of each file; the parent is the nearest heading before of a lower level that no heading of the same or a lower level follows."""
    pattern = r"^(#{1,6})\s+(.+?)\s*#*$"
    h = lines.filter(F.col("fence_lang").isNull() & F.col("content").rlike(pattern))
    h = h.select("path", "line", F.length(F.regexp_extract("content", pattern, 1)).alias("level"), F.trim(F.regexp_extract("content", pattern, 2)).alias("title"))
    w = Window.partitionBy("path").orderBy("line")
    h = h.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= MAX_HEADINGS)
    # The open heading of a level: the last one of that level unless one of a lower level came after it.
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("line"))).over(before) for k in range(1, 6)}
    h = h.withColumns({f"_l{k}": c for k, c in last.items()})
    parent = F.lit(None).cast("int")
    for k in range(1, 6):  # the nearest heading of a lower level is open by construction
        parent = F.when(F.col("level") > k, F.greatest(parent, F.col(f"_l{k}"))).otherwise(parent)
    return h.select("path", "line", "level", "title", "ord", parent.alias("parent_line"))


def markdown_stats(lines: DataFrame) -> DataFrame:
    """path, words, links, languages (sorted) outside fences."""
    out = F.col("fence_lang").isNull()
    words = F.size(F.filter(F.split("content", r"\s+"), lambda x: x != ""))
    links = F.regexp_count("content", F.lit(r"\[[^\]]*\]\([^)]*\)"))
    return lines.groupBy("path").agg(
        F.sum(F.when(out, words).otherwise(0)).alias("words"), F.sum(F.when(out, links).otherwise(0)).cast("long").alias("links"), F.array_join(F.sort_array(F.collect_set("fence_lang")), ",").alias("languages"),
    )


# ---- JSON ----


def relax_json(text: str) -> str:
    """Without comments and trailing commas; strings are left alone."""
    parts = re.findall(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|$)|[^"/]+|.', text, re.S)
    plain = [p if p[:1] == '"' else "" if p[:2] in ("//", "/*") else p for p in parts]
    joined = "".join(plain)
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[^",]+|,|"', joined, re.S)
    out: list[str] = []
    for k, t in enumerate(tokens):
        if t == "," and k + 1 < len(tokens) and tokens[k + 1].lstrip()[:1] in ("}", "]") and tokens[k + 1].strip():
            continue
        out.append(t)
    return "".join(out)


def parse_json(path: str, text: str) -> dict:
    error = None
    try:
        value = json.loads(text)
    except ValueError:
        try:
            value, error = json.loads(relax_json(text)), "non-strict JSON (comments or trailing commas) parsed leniently"
        except ValueError as e:
            return {"error": f"invalid JSON: {str(e)[:120]}"}
    first: dict[str, int] = {}
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        for raw in re.findall(r'"((?:[^"\\]|\\.)*)"\s*:', line):
            for key in (raw, re.sub(r"\\(.)", r"\1", raw)):
                first.setdefault(key, n)
    kinds = {bool: "boolean", str: "string", dict: "object", list: "array", type(None): "null"}
    symbols: list[tuple] = []

    def walk(v, at: str, line: int, depth: int) -> None:
        if len(symbols) >= MAX_KEYS or depth > MAX_DEPTH:
            return
        if at:
            parent = f"{path}#{at.rpartition('.')[0]}@json-key:0" if "." in at else None
            symbols.append((f"{path}#{at}@json-key:{line}", at, "json-key", line, line, f"{at}: {kinds.get(type(v), 'number')}", None, parent))
        items = v.items() if isinstance(v, dict) else ((str(k), x) for k, x in enumerate(v[:MAX_ITEMS])) if isinstance(v, list) else ()
        for k, x in items:
            walk(x, f"{at}.{k}" if at else k, first.get(k, 1), depth + 1)

    walk(value, "", 1, 0)
    top = list(value) if isinstance(value, dict) else [str(k) for k in range(len(value))] if isinstance(value, list) else []
    return {"symbols": symbols, "summary": "JSON keys: " + ", ".join(top[:TOP_KEYS]) if top else "JSON scalar document", "error": error}


# ---- scripts ----

_LEX = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT = re.compile(rf"\bimport\s+(?:type\s+)?(?P<what>[^;'\"`]*?)\s*from\s*(?P<q>['\"])|\bimport\s*(?P<q2>['\"])|\bexport\s+(?:type\s+)?(?P<re>\*(?:\s+as\s+{_NAME})?|\{{[^}}]*\}})\s*from\s*(?P<q3>['\"])|\b(?:import|require)\s*\(\s*(?P<q4>['\"`]?)")
_DECL = re.compile(rf"(?P<export>\bexport\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?\b(?P<kind>class|interface|type|enum|namespace|module|function)\b\s*\*?\s*(?P<name>{_NAME})?")
_CONST = re.compile(rf"(?P<export>\bexport\s+)?\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]+)?=\s*(?P<arrow>(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*(?::[^=;{{]+)?=>|(?:async\s+)?function\b)?")
_MEMBER = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|readonly|override|async|abstract|get|set)\s+)*(?P<name>#?{_NAME})\s*(?P<call>\??(?:<[^>]*>)?\()?", re.M)
_CALL = re.compile(rf"(?P<name>(?:{_NAME}\.)*{_NAME})\s*\(")
_EXPORT_LIST = re.compile(r"\bexport\s*\{([^}]*)\}(?!\s*from)")
_EXPORT_DEFAULT = re.compile(rf"\bexport\s+default\s+(?P<name>{_NAME})\s*;?")
_HERITAGE = re.compile(r"\b(extends|implements)\s+([^{]*?)(?=\bimplements\b|\{|$)")
_NO_CALL = set("if for while switch catch return function typeof await new super import require constructor class throw delete void in of do else case".split())


def blank_script(text: str) -> str:
    """Comments and the insides of strings as spaces; same length, line feeds kept."""
    space = lambda s: re.sub(r"[^\n]", " ", s)
    return _LEX.sub(lambda m: space(m[0]) if m[0][0] == "/" else m[0][0] + space(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], text)


def _braces(code: str) -> dict[int, int]:
    """The place behind the closing brace for each opening one."""
    open_, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out | {k: len(code) for k in open_}


def parse_script(path: str, text: str) -> dict:
    code = blank_script(text)
    feeds = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(feeds, at) + 1
    close = _braces(code)
    opens = sorted(close)
    inside_import = []
    imports, exports = [], []
    for m in _IMPORT.finditer(code):
        q = next((g for g in ("q", "q2", "q3", "q4") if m[g] is not None), "q4")
        if m[q]:
            end = text.find(m[q], m.end())
            spec = text[m.end() : end] if end >= 0 else "<dynamic>"
        else:
            spec = "<dynamic>"
        names, local = [], []
        what = m["what"] or (m["re"] if m["re"] else "") or ""
        group = re.search(r"\{([^}]*)\}", what)
        head = what[: group.start()] if group else what
        for part in head.split(","):
            part = part.strip()
            if part.startswith("*"):
                names.append("*")
                local.append(part.rpartition("as")[2].strip() if " as " in part else "*")
            elif re.fullmatch(_NAME, part):
                names.append("default")
                local.append(part)
        for item in (group[1].split(",") if group else []):
            a, _, b = item.strip().removeprefix("type ").partition(" as ")
            if a.strip():
                names.append(a.strip())
                local.append((b or a).strip())
        imports.append((spec, names, local, line(m.start())))
        inside_import.append((m.start(), m.end()))
        if m["re"]:
            exports.extend("*" if n == "*" else x for n, x in zip(names, local, strict=True))
    found: list[dict] = []

    def body(at: int) -> tuple[int, int] | None:
        k = bisect.bisect_left(opens, at)
        semi = code.find(";", at)
        if k < len(opens) and (semi < 0 or opens[k] < semi):
            return opens[k], close[opens[k]]
        return None

    def add(name, kind, at, stop, export, parent=None):
        sig = re.sub(r"\s+", " ", text[at : (code.find("{", at) if 0 <= code.find("{", at) < stop else stop)]).strip()[:200]
        found.append({"name": name, "kind": kind, "at": at, "stop": stop, "export": export, "sig": sig, "parent": parent, "id": f"{path}#{name}@{kind}:{line(at)}"})
        return found[-1]

    heritages = []
    for m in _DECL.finditer(code):
        kind = {"module": "namespace"}.get(m["kind"], m["kind"])
        if not m["name"] or any(a <= m.start() < b for a, b in inside_import) or re.search(r"[.\w$]\s*$", code[max(0, m.start() - 1) : m.start()]):
            continue
        span = body(m.end())
        stop = span[1] if span else (code.find(";", m.end()) + 1 or len(code))
        s = add(m["name"], kind, m.start(), stop, "default" if m["default"] else "named" if m["export"] else None)
        if m["export"]:
            exports.append("default" if m["default"] else m["name"])
        if kind in ("class", "interface") and span:
            for verb, parents in _HERITAGE.findall(code[m.end() : span[0]]):
                for p in re.split(r",(?![^<]*>)", parents):
                    p = re.sub(r"<.*", "", p, flags=re.S).strip()
                    if p:
                        heritages.append((s["id"], verb, p, line(m.start())))
            depth_spans = [(o, close[o]) for o in opens if span[0] < o and close[o] <= span[1]]
            at = 0
            tops = []
            for o, c in depth_spans:
                if o >= at:
                    tops.append((o, c))
                    at = c
            inner = list(code[span[0] + 1 : span[1] - 1])
            for o, c in tops:
                for k in range(o - span[0] - 1, min(c - span[0] - 1, len(inner))):
                    if inner[k] != "\n":
                        inner[k] = " "
            for mm in _MEMBER.finditer("".join(inner)):
                name = mm["name"]
                where = span[0] + 1 + mm.start("name")
                if name in _NO_CALL and name != "constructor":
                    continue
                own = next((c for o, c in tops if o >= where and not re.search(r";", code[where:o])), None)
                end = own if own and mm["call"] else code.find("\n", where) if code.find("\n", where) >= 0 else len(code)
                add(f"{m['name']}.{name}", "method" if mm["call"] else "property", where, end, None, s["id"])
    for m in _CONST.finditer(code):
        if m["arrow"] or m["export"]:
            span = body(m.end()) if m["arrow"] else None
            stop = span[1] if span else (code.find(";", m.end()) + 1 or len(code))
            add(m["name"], "function" if m["arrow"] else "variable", m.start(), stop, "named" if m["export"] else None)
            if m["export"]:
                exports.append(m["name"])
    named = {}
    for m in _EXPORT_LIST.finditer(code):
        for item in m[1].split(","):
            a, _, b = item.strip().removeprefix("type ").partition(" as ")
            if a.strip():
                exports.append((b or a).strip())
                named[a.strip()] = "default" if b.strip() == "default" else "named"
    for m in _EXPORT_DEFAULT.finditer(code):
        if m["name"] not in ("class", "function", "async", "abstract", "interface"):
            exports.append("default")
            named[m["name"]] = "default"
    for s in found:
        s["export"] = s["export"] or (named.get(s["name"]) if s["parent"] is None else None)
    found.sort(key=lambda s: (s["at"], -s["stop"]))
    callers = [s for s in found if s["kind"] in ("function", "method")]
    calls = []
    declared = {(s["at"] + len(s["name"])) for s in found}
    heads = [s["at"] for s in callers]
    for m in _CALL.finditer(code):
        name = m["name"].removeprefix("this.")
        if name.split(".")[-1] in _NO_CALL or re.search(r"\bfunction\s*\*?\s*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        k = bisect.bisect_right(heads, m.start()) - 1
        owner = next((callers[j] for j in range(k, -1, -1) if callers[j]["stop"] > m.start()), None)
        if owner and m.start() - owner["at"] < len(owner["name"].rpartition(".")[2]) and owner["kind"] == "method":
            continue  # the method's own name
        calls.append((owner["id"] if owner else None, name, line(m.start())))
    symbols = [(s["id"], s["name"], s["kind"], line(s["at"]), line(max(s["at"], s["stop"] - 1)), s["sig"], s["export"], s["parent"]) for s in found]
    return {"symbols": symbols, "imports": imports, "exports": list(dict.fromkeys(exports)), "calls": calls, "heritages": heritages}


# ---- all files ----


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, text. One row of PARSED for each JSON and script file, by its extension; a parser that fails leaves its error."""
    d = files.select("path", "text", parser_of(F.col("path")).alias("parser")).filter("parser in ('json', 'script')")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, parser in zip(b["path"], b["text"], b["parser"], strict=True):
                try:
                    got = (parse_json if parser == "json" else parse_script)(path, text or "")
                except Exception as e:  # one bad file must not stop the index
                    got = {"error": f"{type(e).__name__}"}
                rows.append([path, parser, got.get("symbols", []), got.get("imports", []), got.get("exports", []), got.get("calls", []), got.get("heritages", []), got.get("summary"), got.get("error")])
            yield pd.DataFrame(rows, columns=NAMES)

    return d.mapInPandas(run, PARSED)


def summary_with_code(summary: Column, languages: Column) -> Column:
    """The summary of a file with the languages of its fenced code behind a bar."""
    return F.when(F.coalesce(languages, F.lit("")) == "", summary).otherwise(F.concat_ws(" | ", summary, F.concat(F.lit("code: "), languages)))


def stack_frames(traces: DataFrame, limit: int = 50, max_chars: int = 64 * 1024) -> DataFrame:
    """traces: trace_id, text. trace_id, ord, path, line, source of the frames of a stack trace: Java's first, then
    Python's, then any path with a line, each path and line once, ``limit`` at most."""
    from lodestone.functions.paths import plausible_frame_path

    text = F.substring("text", 1, max_chars)
    forms = [
        ("java", r"\(([\w$./-]+\.java):(\d+)\)", text),
        ("python", r'File "([^"\n]+)", line (\d+)', text),
        ("file-line-col", r"(?:^|[\s(\[])((?:[A-Za-z]:)?[^\s()\[\]{}:'\"`,]+?\.[A-Za-z0-9]+):(\d+)(?::(\d+))?", text),
    ]
    none = F.array().cast("array<struct<path:string,line:int,source:string>>")

    def of(name: str, pattern: str, t: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("l"))
        return F.transform(both, lambda x: F.struct(x["p"].alias("path"), F.coalesce(x["l"].try_cast("int"), F.lit(0)).alias("line"), F.lit(name).alias("source")))

    every = F.concat(*[F.coalesce(of(*f), none) for f in forms])
    flat = traces.select("trace_id", F.posexplode(every).alias("ord", "f")).select("trace_id", "ord", "f.*").filter(plausible_frame_path(F.col("path")))
    first = flat.groupBy("trace_id", "path", "line").agg(F.min(F.struct("ord", "source")).alias("x")).select("trace_id", "path", "line", "x.ord", "x.source")
    w = Window.partitionBy("trace_id").orderBy("ord")
    return first.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= limit).select("trace_id", "ord", "path", "line", "source")
