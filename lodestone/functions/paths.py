"""Paths: normal forms, kinds of files, glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.text import tokenize


def to_posix(path: Column) -> Column:
    """Forward slashes, no drive, no empty or ``.`` segment; ``..`` goes up but never above the root."""
    p = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^[A-Za-z]:", ""), "^/+", "")
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Without the last segment; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ext_name(path: Column) -> Column:
    """The last extension with its dot, in lower case; none if the dot comes first."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def detect_language(path: Column) -> Column:
    ext, out = ext_name(path), None
    for language, exts in config.EXTENSIONS.items():
        out = F.when(ext.isin(*exts), language) if out is None else out.when(ext.isin(*exts), language)
    return out.otherwise("generic")


def parser_of(path: Column) -> Column:
    """The parser that takes a path; the generic one takes what the others don't."""
    language = detect_language(path)
    return F.when(language.isin("typescript", "javascript"), "script").when(language.isin("json", "markdown"), language).otherwise("generic")


def is_test_file(path: Column) -> Column:
    lower = F.lower(path)
    base = base_name(lower)
    return base.rlike(r"\.(test|spec)\.[a-z]+$|\.(test|spec)\.[jt]sx?$") | lower.contains("/__tests__/") | lower.contains(".test.") | base.startswith("test-")


def source_of_test(path: Column) -> Column:
    """The file that a test tests, by its name; null for others."""
    plain = F.regexp_replace(path, r"(\.test|\.spec)(?=\.[^.]+$)", "")
    ext = ext_name(path)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    cut = F.regexp_replace(stem, r"(_test|\.test)$", "")
    return F.when(plain != path, plain).when(cut != stem, F.concat(cut, ext))


def has_traversal(path: Column) -> Column:
    """``..`` as a whole segment."""
    return F.array_contains(F.split(path, r"[/\\]"), "..")


def path_tokens(path: Column) -> Column:
    """Words of a path; the extension and names that say nothing are left out."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"(?i)\.[a-z0-9]+$", "")
    return tokenize(F.regexp_replace(p, r"(^|/)(packages?|libs?|modules?|ts|js|src|lib)($|/|$)", " "))


def _posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test_path(path: Column) -> Column:
    return _posix(path).rlike(config.TEST_PATH)


def is_lockfile(path: Column) -> Column:
    return base_name(F.lower(_posix(path))).isin(*config.LOCKFILES)


def is_docs(path: Column) -> Column:
    return _posix(path).rlike(config.DOCS_PATH)


def is_ci_config(path: Column) -> Column:
    return _posix(path).rlike(config.CI_PATH)


def is_source(path: Column) -> Column:
    p = _posix(path)
    return p.rlike(config.SOURCE_PATH) & ~p.rlike(config.TEST_PATH) & ~p.rlike(config.DECLARATION_PATH)


def is_fully_parsed(path: Column) -> Column:
    return _posix(path).rlike(config.PARSED_PATH)


def is_generated_or_lockfile(path: Column) -> Column:
    p = F.lower(_posix(path))
    return p.rlike(config.GENERATED_PATH) | base_name(p).isin(*config.SEED_LOCKFILES)


def sensitive_reason(path: Column) -> Column:
    """Why a path is sensitive; null if it isn't."""
    return F.coalesce(*[F.when(path.rlike(pattern), reason) for pattern, reason in config.SENSITIVE_PATHS])


def is_entry_point(path: Column) -> Column:
    return base_name(F.lower(path)).rlike(config.ENTRY_POINT) & ~path.contains("node_modules")


def is_under(path: Column, folder: Column) -> Column:
    return (folder == "") | (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def plausible_frame_path(path: Column) -> Column:
    return F.length(path).between(1, 512) & ~path.rlike("(?i)^(node|https?|ext|data):") & ~path.startswith("<")


_GLOB = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", re.S)
_GLOB_PARTS = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str, anchored: bool) -> str:
    """An ignore pattern as a regular expression that Java and RE2 read alike."""
    body = "".join(_GLOB_PARTS.get(t) or (t if t[0] == "[" and len(t) > 1 else re.escape(t)) for t in _GLOB.findall(glob))
    return f"{'^' if anchored else '(?:^|/)'}{body}(?:$|/)"


def base_matches(base: Column, candidate: Column) -> Column:
    """The share of a file-name match: 1 if equal, a half for a beginning of four characters or more, else null."""
    return F.when(base == candidate, 1.0).when((F.length(candidate) >= 4) & base.startswith(candidate), 0.5)


def canonical_base(path: Column) -> Column:
    from lodestone.functions.text import canonical_term

    return canonical_term(F.regexp_replace(base_name(path), r"\.[^.]+$", ""))
