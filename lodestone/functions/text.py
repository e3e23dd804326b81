"""Scalar text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config

WORD = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"


def words_in(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def tokenize_identifier(text: Column) -> Column:
    """Lower-case words of an identifier or of a text; case changes and other characters part them. ASCII only."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def canonical_term(text: Column) -> Column:
    return F.array_join(tokenize_identifier(text), "")


def identifier_variants(text: Column) -> Column:
    """The distinct joined, snake and kebab forms; empty for a text without words."""
    t = tokenize_identifier(text)
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*[F.array_join(t, s) for s in ("", "_", "-")])))


def is_stopword(word: Column) -> Column:
    return F.lower(word).isin(*config.STOPWORDS)


def strip_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~is_stopword(w))


def body_words(text: Column) -> Column:
    """All words of a body that count: two characters or more, no stopword."""
    return F.filter(tokenize_identifier(text), lambda w: (F.length(w) >= 2) & ~w.isin(*config.STOPWORDS))


def extract_identifiers(text: Column, limit: int | None = config.LEXICAL.identifiers) -> Column:
    """Distinct identifiers of three characters or more, in order of appearance, at most ``limit``; all of them if it is None."""
    every = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]{2,}"), F.lit(0)))
    return every if limit is None else F.slice(every, 1, limit)


def analyze_query(text: Column) -> dict[str, Column]:
    """The parts of a free-text query: quoted_phrases, words, file_hints, identifier_candidates, terms, exact_candidates."""
    quoted = r""""([^"]+)"|'([^']+)'"""
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(quoted), F.lit(0)), lambda q: F.trim(F.substr(q, F.lit(2), F.length(q) - 2))), lambda q: q != "")
    parts = F.split(F.regexp_replace(text, quoted, " "), r"[\s,;:!?()\[\]{}]+")
    words = F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"^[^\w$@/]+|[^\w$./]+$", "")), lambda w: (w != "") & ~is_stopword(w))
    hint = lambda w: w.rlike(r"\.[A-Za-z0-9]+$")
    cleaned = F.transform(F.filter(words, lambda w: ~hint(w)), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_$]+|[^A-Za-z0-9_$]+$", ""))
    candidates = F.filter(cleaned, lambda w: w.rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$"))
    tokens = lambda ws: F.flatten(F.transform(ws, tokenize_identifier))
    return {
        "quoted_phrases": phrases,
        "words": words,
        "file_hints": F.transform(F.filter(words, hint), F.lower),
        "identifier_candidates": candidates,
        "terms": F.array_distinct(F.concat(tokens(words), tokens(phrases))),
        "exact_candidates": F.filter(F.array_distinct(F.transform(candidates, canonical_term)), lambda c: c != ""),
    }


def tokenize(text: Column) -> Column:
    """The words of the evaluation: case boundaries part them, the rest is lower-cased and cut at other characters."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(text: Column) -> Column:
    return F.filter(tokenize(text), lambda t: ~t.isin(*config.EVAL_STOPWORDS))


def word_count(text: Column) -> Column:
    """Content words but for version marks such as v2."""
    return F.size(content_words(F.regexp_replace(text, r"(?i)\bv\d+\b", " ")))


def clean_task_text(subject: Column, body: Column) -> Column:
    """A commit message as a task: no trailers, links, addresses or issue numbers; the subject if nothing is left."""
    trailer = r"(?i)^(co-authored-by|signed-off-by|reviewed-by|acked-by|reported-by|tested-by)\s*:"
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(trailer))
    out = F.trim(F.concat_ws(" ", subject, F.array_join(lines, " ")))
    for pattern, by in (
        (r"(?i)\(cherry picked from commit [0-9a-f]+\)", ""), (r"https?://\S+", " "), (r"(?i)[a-z0-9.\-+/]+@[a-z0-9.\-]+", " "), (r"\(#\d+\)", " "),
        (r"(?<!\S)#\d+(?!\S)", " "), (r"(?i)^merge pull request #\d+ from \s*", ""), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.when(F.trim(out) != "", F.trim(out)).otherwise(F.trim(subject))


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def estimate_tokens_approx(tokens: Column) -> Column:
    """To the nearest ten, halves up, ten at least."""
    return F.greatest(F.lit(10), F.floor(tokens / 10 + 0.5) * 10).cast("long")


def fence_length(text: Column) -> Column:
    """One more back-tick than the longest run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def split_lines(text: Column) -> Column:
    """Lines; what follows the last line feed is one only if it isn't empty."""
    lines = F.split(text, r"\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def number_lines(lines: Column, first: Column | int = 1) -> Column:
    """``N: line`` for each, joined by line feeds."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x)), "\n")


def redaction_placeholder(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), kind, F.lit(":"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))


def shannon_entropy(text: Column) -> Column:
    """Bits for each character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


PLACEHOLDERS = ["changeme", "change_me", "example", "placeholder", "your_", "your-", "dummy", "sample", "redacted", "<", "${", "{{", "process.env"]


def is_placeholder(value: Column) -> Column:
    """Values that nobody would guard. What counts was not published; this list is our own."""
    v = F.lower(value)
    return v.rlike(r"^(.)\1*$") | v.isin("test", "none", "null", "undefined", "password", "secret", "token") | F.exists(words_in(*PLACEHOLDERS), lambda p: v.contains(p))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points, as a long. The product is made of 16-bit halves, so it never overflows."""
    mask = 4294967295
    mul = lambda a: ((a.bitwiseAND(65535) * 16777619) + F.shiftleft((F.shiftright(a, 16) * 16777619).bitwiseAND(65535), 16)).bitwiseAND(mask)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: mul(a.bitwiseXOR(c)))


def safe_failure_category(message: Column) -> Column:
    """An error class that may be shown: never the message itself."""
    m = F.lower(message)
    return (
        F.when(m.rlike("timeout|timed out"), "timeout").when(m.rlike("enoent|no such file|not found"), "not-found").when(m.rlike("eacces|eperm|permission"), "permission")
        .when(m.rlike("ebusy|emfile|eagain|locked"), "busy").when(m.rlike("syntax|parse|unexpected token"), "syntax").otherwise("unknown")
    )


def is_transient_failure(category: Column) -> Column:
    return category.isin("timeout", "busy", "permission")


def exact_weight_for_kind(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 1.0).when(kind.isin("class", "namespace"), 0.9).when(kind == "enum", 0.7).when(kind.isin("interface", "type"), 0.4).otherwise(0.6)


def explain_signal(kind: Column, weight: Column, detail: Column) -> Column:
    """One sentence for a signal."""
    out = F.when(kind == "LEXICAL", F.format_string("Lexical match (score %.2f): %s", weight, detail)).when(kind == "ENTRY_POINT", "Project entry point")
    optional = F.when(F.coalesce(detail, F.lit("")) != "", F.format_string(" (%s)", detail)).otherwise("")
    out = out.when(kind == "OPEN_EDITOR", F.concat(F.lit("Open in your editor"), optional)).when(kind == "SELECTION", F.concat(F.lit("Explicitly selected in your editor"), optional))
    for k, text in config.SIGNAL_TEXT.items():
        out = out.when(kind == k, F.format_string(text, detail))
    return out


def explain_signals(signals: Column) -> Column:
    """signals: array<struct<kind, weight, detail>>. Sentences, the greatest weight first, ties by kind."""
    keyed = F.transform(signals, lambda s: F.struct((-s["weight"]).alias("w"), s["kind"].alias("kind"), s["weight"].alias("weight"), s["detail"].alias("detail")))
    return F.transform(F.array_sort(keyed), lambda s: explain_signal(s["kind"], s["weight"], s["detail"]))
