"""Quality rules by suffix-array repetition.

The words of a batch of documents are numbered so that no two documents share a number, the suffixes of
all of them are sorted by prefix doubling, and the longest common prefixes of neighbours in that order
(the bounds of the LCP intervals) give, for every word, the longest substring beginning there that occurs
again in its document. The spans of maximal repeats are united, those of ``MIN_WORDS`` words or more and again those of
``PASSAGE_WORDS`` or more; a document is dropped if they cover too much of it or if one of them is too long.

A null text counts as empty: no words, base_failed, not kept. Bytes that are not UTF-8 count as they are; word_chars
counts U+FFFD for them. Empty tables give no rows, repeated rows are judged alike, long texts are judged whole (alone in their
batch if need be; some 60 bytes of memory for each word and 150 for each different one), other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import decoded, texts_map
from lodestone.llm.common import aside, clean_name

MIN_WORDS = 8
#: A repeat of so many words is a passage; passages may cover this share of a document. Documents with a repeated line of
#: eight or ten words are common and good, so the shorter repeats have only the base rule's limit.
PASSAGE_WORDS, MAX_COVERED = 16, 0.2
#: The longest repeat may have as many words, or this share of the document if that is more.
MAX_REPEAT, MAX_REPEAT_SHARE = 60, 0.15
WHITE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Bytes of a text whose words are objects at once.
PIECE = 4 << 20
#: Suffixes that are gone through at a time.
STRIDE = 1 << 16

SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_passage_words", "longest_repeat")])


def suffix_order(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes in order. ids must not be shared between documents; ends[i] is the end of i's document. By prefix
    doubling, of which only the last ranks are kept; only suffixes that still share their rank are sorted again."""
    n = len(ids)
    starts = np.concatenate(([0], np.cumsum(np.bincount(ids)))).astype(np.int32)
    rank = starts[ids]
    active = np.flatnonzero((starts[ids + 1] - rank) > 1).astype(np.int32)
    del starts
    k = 1
    while len(active):
        nxt = active.astype(np.int64) + k
        second = np.where(nxt < ends[active], rank[np.minimum(nxt, n - 1)] + 1, 0).astype(np.int32)
        del nxt
        order = np.argsort(rank[active].astype(np.int64) * (n + 2) + second, kind="stable")
        active, second = active[order], second[order]
        del order
        r = rank[active]
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_key = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        del second
        at = np.arange(len(r), dtype=np.int32)
        rank[active] = r + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        active = active[~(new_key & np.concatenate((new_key[1:], [True])))]
        active.sort()
        k *= 2
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return order


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the length of the longest substring from there that its document has twice: the longest
    common prefix with either neighbour in the order of the suffixes. The first words are compared for all suffixes at once;
    what shares more than those is gone through in the order of the text, where each prefix is at most one word
    shorter than the one before, so the whole takes linear time and a few numbers for each word."""
    n = len(ids)
    order = suffix_order(ids, ends)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(0, n - 1), np.int32)
    live = np.arange(len(lcp), dtype=np.int32)
    for k in range(MIN_WORDS):
        x, y = a[live].astype(np.int64) + k, b[live].astype(np.int64) + k
        there = (x < n) & (y < n)
        same = there & (ids[np.minimum(x, n - 1)] == ids[np.minimum(y, n - 1)])
        live = live[same]
        lcp[live] = k + 1
    # live: pairs with MIN_WORDS common words or more, now by the place of the later suffix in the text.
    live = live[np.argsort(b[live], kind="stable")]
    word, h, before, longer = memoryview(ids), 0, -2, np.empty(len(live), np.int32)
    for at in range(0, len(live), STRIDE):
        part = live[at : at + STRIDE]
        for k, (x, y) in enumerate(zip(a[part].tolist(), b[part].tolist(), strict=True), at):
            h = max(h - 1, MIN_WORDS) if y == before + 1 else MIN_WORDS
            while x + h < n and y + h < n and word[x + h] == word[y + h]:
                h += 1
            longer[k], before = h, y
    lcp[live] = longer
    best = np.zeros(n, np.int32)
    best[a] = lcp
    best[b] = np.maximum(best[b], lcp)
    return best


def _word_ids(text: bytes, base: int) -> tuple[np.ndarray, int]:
    """The words' numbers from ``base`` on, by first appearance, and how many words differ. Pieces of a long text are split
    one after the other, so its words are never all in memory as objects."""
    number: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in WHITE:
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter([number.setdefault(w, len(number) + base) for w in words], np.int32, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), len(number)


def measure(texts: list[bytes | None], min_words: int = MIN_WORDS) -> dict[str, list]:
    """min_words: the shortest repeat that covers."""
    out: dict[str, list] = {n: [] for n in SCHEMA.names}
    parts: list[np.ndarray] = []
    base = 0
    for text in texts:
        text = text or b""
        own, distinct = _word_ids(text, base)
        parts.append(own)
        base += distinct
        chars = len(decoded(text))
        out["word_chars"].append(chars - (len(text) - len(text.translate(None, WHITE))))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    sizes = [len(x) for x in parts]
    count = np.array(sizes, np.int64)
    stop = np.cumsum(count)
    covered, passages, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    if base:
        ids, has = np.concatenate(parts), np.flatnonzero(count)
        n = len(ids)
        best = longest_repeats(ids, np.repeat(stop.astype(np.int32), count))
        first = (stop - count)[has]
        for least, out_of in ((min_words, covered), (PASSAGE_WORDS, passages)):
            start = np.flatnonzero(best >= least)
            edge = np.bincount(start, minlength=n + 1) - np.bincount(start + best[start], minlength=n + 1)
            out_of[has] = np.add.reduceat((np.cumsum(edge)[:n] > 0).astype(np.int64), first)
        longest[has] = np.maximum.reduceat(best, first)
    return out | {"n_words": sizes, "n_repeat_words": covered.tolist(), "n_passage_words": passages.tolist(), "longest_repeat": longest.tolist()}


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    words, covered = F.col("n_words"), F.col("n_repeat_words")
    base = (words < 20) | (100 * covered > 30 * words)
    limit = F.greatest(F.lit(float(MAX_REPEAT)), MAX_REPEAT_SHARE * words)
    keeps = (F.col("n_passage_words") <= MAX_COVERED * words) & (F.col("longest_repeat") <= limit)
    return measured.withColumns({"base_failed": base, "kept": ~base & keeps, "covered_fraction": F.when(words > 0, covered / words).otherwise(0.0)})


def query(docs: DataFrame) -> DataFrame:
    d = clean_name(docs, "doc_id", "text")
    return judged(texts_map(d, "text", lambda: measure, SCHEMA))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, whole and with all their columns, whatever they are called."""
    return judged(texts_map(aside(docs, "text"), "text", lambda: measure, SCHEMA)).filter("kept").select("row.*")
